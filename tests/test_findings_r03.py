"""Faults found in review: each test failed on the code before."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from riffle.catalog import ORACLES, QUERIES
from riffle.functions import geo
from riffle.operators import search as Se
from riffle.operators import windows as Wn


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_midpoint_reads_its_line_once(spark):
    df = spark.sql("SELECT 'LINESTRING (0 0, 4 0, 4 2)' AS w")
    m = df.select(geo.polyline_midpoint(geo.wkt_vertices("w")).alias("m"))
    assert plan(m).count("regexp_extract_all") <= 2
    assert (m.first()["m"]["lng"], m.first()["m"]["lat"]) == (3.0, 0.0)


def test_tile_of_a_long_station_number(spark, tmp_path):
    row = spark.createDataFrame([(1, 2, 12345, 3, 1.0, 2.0, 0.1, 0.2, "A", "O", dt.datetime(1996, 9, 13))], (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"))
    row.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in QUERIES["x11_keys"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == con.execute(ORACLES["x11_keys"]).fetchall()


def test_equal_documents_rank_by_key(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.range(40).select("id", F.lit(" ".join(words)).alias("text")).unionByName(
        spark.range(40, 300).select("id", F.concat_ws(" ", *[F.when(F.col("id") % (i + 2) == 0, w) for i, w in enumerate(words)]).alias("text")))
    asked = spark.range(5).select(F.col("id").alias("qid"), F.explode(F.array(*[F.lit(w) for w in words])).alias("token"))
    text = F.col("text")
    got = Se.search_many(Se.postings(docs, "id", text), "id", Se.stats(docs, "id", text), asked, 10).orderBy("qid", "rank")
    assert [(r["qid"], r["id"]) for r in got.collect()] == [(q, i) for q in range(5) for i in range(10)]


def test_trailing_means_add_up_in_growing_frames(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 23), 1.0), (1, dt.datetime(2024, 1, 2, 23), 3.0),
                                (1, dt.datetime(2024, 1, 2, 23), None), (None, dt.datetime(2024, 1, 3), 5.0)], "k int, ts timestamp, v double")
    out = Wn.trailing_means(df, "k", "ts", {"m": "v"})
    assert "RangeFrame" not in plan(out)
    assert sorted(r["m"] for r in out.collect()) == [1.0, 2.0, 2.0, 5.0]


def test_pieces_of_lines_are_written_before_they_are_joined(spark):
    from riffle.operators import spatial as S

    lines = spark.sql("SELECT 7 AS k, array(named_struct('lng', -80D, 'lat', 44D), named_struct('lng', -79D, 'lat', 44D)) AS v")
    points = spark.createDataFrame([(44.001, -79.5), (44.5, -79.5)], "lat double, lng double")
    found = S.nearest_line(points, lines, 0.002, "k", "v", piece_deg=0.1)
    assert "Generate" not in plan(found)
    assert [(r["l_lat"], r["k"]) for r in found.collect()] == [(44.001, 7)]


def test_points_meet_in_blocks(spark):
    from riffle.operators import spatial as S

    left = spark.createDataFrame([(44.0, -80.0), (44.2, -80.0), (50.0, -80.0)], "lat double, lng double")
    right = spark.createDataFrame([(44.1, -80.0, 2**60, 0.5, 9), (44.1, -80.0, 1, None, 8), (44.3, -80.0, 5, float("inf"), 7)],
                                  "lat double, lng double, a long, b double, id int")
    sums = S.radius_sums(left, right, 0.11, S.DEGREES, {"a": F.col("a"), "b": F.col("b")})
    near = S.nearest(left, right, S.DEGREES, "id", bound=0.11)
    assert "MapInArrow" in plan(sums) and "MapInArrow" in plan(near)
    assert {(r["l_lat"], r["a"], r["b"]) for r in sums.collect()} == {(44.0, 2**60 + 1, 0.5), (44.2, 2**60 + 6, float("inf"))}
    # two locations at the same distance but for the last bits
    assert {(r["l_lat"], r["id"]) for r in near.collect()} >= {(44.0, 8)}


def test_blocks_are_compared_in_steps_and_split_by_one_level(spark, monkeypatch):
    import math
    import random

    from riffle.operators import spatial as S

    rng, steps, split = random.Random(5), [], S._split
    left, right = ([(44 + rng.random() / 5, -80 + rng.random() / 5, i) for i in range(n)] for n in (200, 300))
    frames = [spark.createDataFrame(x, "lat double, lng double, id int") for x in (left, right)]
    assert len(list(S._steps(200, 300))) > 1
    monkeypatch.setattr(S, "FEW_PAIRS", 0)
    monkeypatch.setattr(S, "_split", lambda *a: steps.append(a[5]) or split(*a))
    near = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    want = {a[:2]: sum(near(a, b) <= 0.05 for b in right) for a in left}
    for limit in (10_000_000, 400):
        got = S.radius_sums(*frames, 0.05, S.DEGREES, {"n": F.lit(1).cast("bigint")}, pair_limit=limit)
        assert {(r["l_lat"], r["l_lng"]): r["n"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert steps and set(steps) == {1}
    monkeypatch.setattr(S, "CROWD", 1000)
    found = {(r["l_lat"], r["l_lng"]): r["id"] for r in S.nearest(*frames, S.DEGREES, "id", bound=0.2).collect()}
    assert found == {a[:2]: min(right, key=lambda b: near(a, b))[2] for a in left}


def test_searches_of_one_plan_run_side_by_side(spark, monkeypatch):
    import threading

    from riffle.plans import access as Acc
    from riffle.plans import features as Fe

    class Met(Exception):
        pass

    gate = threading.Barrier(2, timeout=20)

    def meet(*_, **__):
        gate.wait()
        raise Met

    places = spark.createDataFrame([(44.0, -80.0, 1)], "lat double, lng double, ogf_id long")
    access = spark.createDataFrame([("road", 44.0, -80.0, 1)], "access_type string, lat double, lng double, osm_id long")
    for name in ("with_park_modifier", "with_crown_flag", "bonus_within"):
        monkeypatch.setattr(Acc, name, meet if name != "bonus_within" else lambda *a: a[0])
    with pytest.raises(Met):
        Acc.raw_scores(places, access, None, None)
    monkeypatch.setattr(Fe.S, "with_nearest", meet)
    monkeypatch.setattr(Fe.S, "with_radius_count", meet)
    with pytest.raises(Met):
        Fe.observation_features(places.withColumnsRenamed({"lat": "centroid_lat", "lng": "centroid_lng"}), places)


def test_training_snaps_its_records_once(spark, monkeypatch):
    from riffle.catalog import models as C
    from riffle.domain import Tables

    given = []
    for name in ("presence", "target_group_absence"):
        monkeypatch.setattr(C.M, name, lambda *a, snapped=None, **k: given.append(snapped) or a[1])
    monkeypatch.setattr(C.M, "training_rows", lambda *a: None)
    C.trained(Tables(spark, "/root/testdata/sf0.001"))
    assert len(given) == 2 and given[0] is not None and given[0] is given[1]
