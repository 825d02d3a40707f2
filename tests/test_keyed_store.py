"""Merges by key that rewrite only the parts of their keys."""

import threading

import pytest
from pyspark.sql import functions as F

from riffle.plans.keyed_store import KeyedStore

KEY = ["k"]


def rows_of(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.fixture()
def store(spark, tmp_path):
    return KeyedStore(spark, f"{tmp_path}/store", parts=32)


def batch(spark, pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "k long, v string, at int")


def put(store, spark, pairs, **kw):
    return store.merge("t", batch(spark, pairs), F.col("at"), keys=KEY, **kw)


def test_few_keys_rewrite_their_parts_alone(spark, store):
    put(store, spark, [(i, "old") for i in range(2000)])
    before = store.state("t")
    touched = put(store, spark, [(i, "new") for i in range(0, 2000, 200)])
    after = store.state("t")
    changed = {int(p) for p in after["folders"] if after["folders"][p] != before["folders"][p]}
    assert len(before["folders"]) == 32 and changed == set(touched) and len(touched) <= 10
    got = rows_of(store.read("t"))
    assert len(got) == 2000 and sum(v == "new" for v in got.values()) == 10
    assert set(rows_of(store.read("t", before["version"])).values()) == {"old"}


def test_last_arrival_wins_and_null_keys_take_no_part(spark, store):
    put(store, spark, [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (2, None)])
    assert rows_of(store.read("t")) == {1: "b", 2: None}


def test_a_replayed_batch_changes_nothing(spark, store):
    put(store, spark, [(1, "a")], writer="w", batch_id=0)
    put(store, spark, [(1, "b")], writer="w", batch_id=1)
    assert put(store, spark, [(1, "a")], writer="w", batch_id=0) == [] == put(store, spark, [(9, "z")], writer="w", batch_id=1)
    assert rows_of(store.read("t")) == {1: "b"} and store.versions("t") == [1, 2]
    put(store, spark, [(3, "c")], writer="other", batch_id=0)
    assert rows_of(store.read("t")) == {1: "b", 3: "c"}


def test_empty_batches_and_tables(spark, store):
    assert put(store, spark, [], writer="w", batch_id=4) == [] and store.read("t").count() == 0
    assert store.state("t")["writers"] == {"w": 4} and store.read("barriers").count() == 0


def test_new_columns_are_added(spark, store):
    put(store, spark, [(1, "a"), (2, "b")])
    store.merge("t", spark.createDataFrame([(2, 5.0, 1)], "k long, extra double, at int"), F.col("at"), keys=KEY)
    assert {r["k"]: (r["v"], r["extra"]) for r in store.read("t").collect()} == {1: ("a", None), 2: (None, 5.0)}


def test_known_tables_take_their_key_and_defaults(spark, store):
    df = spark.createDataFrame([(7, "x", 1), (7, "y", 2)], "observation_id long, species string, n int")
    store.merge("observations", df, F.col("n"))
    row = store.read("observations").collect()
    assert [(r.species, r.geoprivacy, r.is_obscured) for r in row] == [("y", "open", False)]


def test_two_writers_lose_nothing(spark, store):
    put(store, spark, [(i, "old") for i in range(50)])
    gate, errors = threading.Barrier(4), []

    def write(n):
        try:
            gate.wait()
            put(store, spark, [(i, f"w{n}") for i in range(n * 10, n * 10 + 10)], writer=f"w{n}", batch_id=0)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and store.versions("t") == [1, 2, 3, 4, 5]
    assert rows_of(store.read("t")) == {i: f"w{i // 10}" if i < 40 else "old" for i in range(50)}


@pytest.mark.parametrize("same_part", [True, False])
def test_the_loser_of_a_race_goes_on_from_the_new_version(spark, store, same_part, monkeypatch):
    put(store, spark, [(i, "old") for i in range(200)])
    parts = {r["k"]: r["p"] for r in spark.range(200).selectExpr("id AS k", "pmod(xxhash64(id), 32) AS p").collect()}
    other = next(k for k in range(1, 200) if (parts[k] == parts[0]) is same_part)
    commit, write, tries, writes = store._commit, store._write, [], []

    def late(table, state):
        tries.append(state["version"])
        if len(tries) == 1:
            put(KeyedStore(spark, store.base), spark, [(other, "other")])
        return commit(table, state)

    monkeypatch.setattr(store, "_commit", late)
    monkeypatch.setattr(store, "_write", lambda *a: writes.append(1) or write(*a))
    put(store, spark, [(0, "mine")])
    got = rows_of(store.read("t"))
    assert (got[0], got[other], len(got), tries) == ("mine", "other", 200, [2, 3])
    assert len(writes) == (2 if same_part else 1)


def test_a_broken_write_is_not_seen_and_is_swept(spark, store, monkeypatch):
    put(store, spark, [(1, "a")])

    def broken(table, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", broken)
        with pytest.raises(RuntimeError):
            put(store, spark, [(1, "b")])
    assert rows_of(store.read("t")) == {1: "a"} and store.vacuum("t") == []
    assert len(store.vacuum("t", older_than_ms=0)) == 1
    put(store, spark, [(1, "c")])
    put(store, spark, [(1, "d")])
    assert len(store.vacuum("t", keep=1, older_than_ms=0)) == 2 and rows_of(store.read("t")) == {1: "d"} and store.versions("t") == [3]


def test_streams_are_writers_by_their_checkpoint(spark, store, tmp_path):
    from riffle.streaming.gauges import upsert_latest

    shape, src = "station_id string, reading_datetime timestamp, discharge_cms double, n long", f"{tmp_path}/in"

    def arrive(*rows):
        spark.createDataFrame([(s, v, n) for s, v, n in rows], "station_id string, discharge_cms double, n long").withColumn(
            "reading_datetime", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint):
        upsert_latest(spark.readStream.schema(shape).parquet(src), store, "stream_gauge_readings", f"{tmp_path}/{checkpoint}", F.col("n"))
        return {r.station_id: r.discharge_cms for r in store.read("stream_gauge_readings").collect()}

    arrive(("a", 1.0, 1), ("a", 2.0, 2), ("b", 3.0, 1))
    assert run("one") == {"a": 2.0, "b": 3.0}
    arrive(("a", 5.0, 1))
    assert run("one") == {"a": 5.0, "b": 3.0} == run("one") and store.versions("stream_gauge_readings") == [1, 2]
    assert run("two") == {"a": 2.0, "b": 3.0}  # a new stream begins with the first batch of its own
