"""Summaries, ordered windows, table maintenance and text against plain Python."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riffle.functions import text as X
from riffle.operators import aggregates as A
from riffle.operators import search as Se
from riffle.operators import tables as Tb
from riffle.operators import windows as Wn


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(r.random(n) < 0.4, 0, r.integers(1, 9, n)),
                        "v": np.round(r.normal(5, 2, n) ** 3, 3)})
    pdf.loc[pdf.index % 11 == 0, "v"] = 7.0
    return pdf, spark.createDataFrame(pdf)


def test_order_statistics(skewed):
    pdf, df = skewed
    n = F.col("n")
    got = {(r["k"], r["name"]): r["v"] for r in A.values_at(
        df, ["k"], "v", {"first": n * 0, "third": F.floor(n / 3)}).collect()}
    for k, g in pdf.groupby("k"):
        v = np.sort(g.v.values)
        assert got[(k, "first")] == v[0] and got[(k, "third")] == v[len(v) // 3]


def test_median_of_skewed_groups(skewed):
    pdf, df = skewed
    got = {r["k"]: r["v"] for r in A.exact_median(df, ["k"], ["v"]).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.median(g.v))


def test_median_keeps_keys_without_values(spark):
    rows = [(1, None, None), (1, None, 3.0), (2, 1e300, 1.0), (2, -5.0, 2.0), (2, 1e-9, 4.0), (None, 8.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in A.exact_median(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (None, 3.0), 2: (1e-9, 2.0), None: (8.0, None)}


def test_quartiles_and_thresholds(skewed):
    pdf, df = skewed
    q = A.quartiles(df, "v").first()
    assert list(q) == pytest.approx(list(np.quantile(pdf.v, [0.25, 0.5, 0.75])))
    got = {r["cut"]: r["threshold"] for r in A.rank_thresholds(df, ["v"], {"p95": 0.05, "p40": 0.6}).collect()}
    d = np.sort(pdf.v.values)[::-1]
    assert got["p95"] == pytest.approx(round(d[int(len(d) * 0.05)], 5))
    assert got["p40"] == pytest.approx(round(d[int(len(d) * 0.6)], 5))


def test_min_max_of_a_flat_column(spark):
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "i int, x double")
    assert {r["s"] for r in A.with_min_max(flat, "x", "s").collect()} == {0.5}


def test_benthic_rules(spark):
    rows = [(1, "Baetidae", "Ephemeroptera", 6.0), (1, "Chironomidae", "Diptera", 4.0),
            (1, "", "Trichoptera", 2.0), (1, "Simuliidae", "Trichoptera", 3.0), (1, "Perlidae", "Plecoptera", 0.0)]
    got = A.benthic_counts(spark.createDataFrame(
        rows, "site_visit_id int, family string, taxon_order string, n double")).first()
    assert (got["ept_count"], got["total_count"], got["ept_richness"], got["total_taxa_richness"]) == (8, 15, 2, 4)


@pytest.fixture(scope="module")
def readings(spark):
    r = np.random.default_rng(2)
    n = 400
    base = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({
        "reading_id": range(n), "station_id": np.where(r.random(n) < 0.5, 0, r.integers(1, 5, n)),
        "ts": [base + dt.timedelta(minutes=int(m)) for m in r.integers(0, 4000, n)],
        "level_m": r.random(n), "discharge_cms": r.random(n) * 10})
    return pdf, spark.createDataFrame(pdf)


def test_closest_in_time(readings):
    pdf, df = readings
    got = {r["reading_id"]: r["ref_level_m"] for r in Wn.closest_in_time(
        df, "station_id", "ts", "reading_id", 3 * 3600, ["level_m"], "ref_").collect()}
    for _, p in pdf.iterrows():
        o = pdf[(pdf.station_id == p.station_id) & (pdf.ts < p.ts)]
        if o.empty:
            assert got[p.reading_id] is None
            continue
        gap = (o.ts - (p.ts - pd.Timedelta(hours=3))).abs()
        best = o.assign(g=gap).sort_values(["g", "ts", "reading_id"]).iloc[0]
        assert got[p.reading_id] == best.level_m


def test_trailing_means(readings):
    pdf, df = readings
    got = {r["reading_id"]: r["m"] for r in Wn.trailing_means(
        df, "station_id", "ts", {"m": "level_m"}).collect()}
    for _, p in pdf.iterrows():
        o = pdf[(pdf.station_id == p.station_id) & (pdf.ts <= p.ts) & (pdf.ts >= p.ts - pd.Timedelta(days=1))]
        assert got[p.reading_id] == pytest.approx(o.level_m.mean())


def test_versions_of_a_crowded_key(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    got = Tb.versions(rows, ["k"], ["id"], "id").toPandas().sort_values(["k", "id"])
    for _, g in got.groupby("k"):
        assert list(g.version) == list(range(1, len(g) + 1))
        assert list(g.contradicted_by[:-1]) == list(g.id[1:]) and g.is_current.sum() == 1


def test_upsert_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    b = b.withColumn("n", F.ascii("v"))
    drop = lambda df: df.drop("n")
    once = drop(Tb.upsert(t, b, ["k"], F.col("n")))
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, drop(Tb.upsert(once, b, ["k"], F.col("n"))).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, drop(Tb.insert_absent(t, b, ["k"], F.col("n"))).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_last_row_of_a_batch_wins_whatever_its_values(spark):
    t = spark.createDataFrame([("k", 0, {"old": "x"})], "k string, v int, tags map<string,string>")
    b = spark.createDataFrame([("k", 9, {"a": "z"}, 1), ("k", 1, {"b": "a"}, 2)], "k string, v int, tags map<string,string>, n int")
    got = Tb.upsert(t, b, ["k"], F.col("n")).collect()
    assert [(r.v, r.tags) for r in got] == [(1, {"b": "a"})]


def test_refine_retires_the_old_row(spark):
    old = spark.createDataFrame([(1, "x", 1, True, None)],
                                "id bigint, conclusion string, version bigint, is_current boolean, contradicted_by bigint")
    new = spark.createDataFrame([(2, "y", 1)], "id bigint, conclusion string, replaces bigint")
    got = {r["id"]: (r["version"], r["is_current"], r["contradicted_by"]) for r in Tb.refine(old, new, "id", "replaces").collect()}
    assert got == {1: (1, False, 2), 2: (2, True, None)}


def test_row_numbers_are_consecutive(spark):
    got = Tb.row_numbers(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"], "n").collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]


def context(text, word, window=600, cap=3000):
    low, spots, at = text.lower(), [], 0
    while (p := low.find(word.lower(), at)) >= 0:
        spots.append(p)
        at = p + len(word)
    if not spots:
        return None
    kept, parts = [], []
    for p in spots[:5]:
        s, e = max(0, p - window), min(len(text), p + len(word) + window)
        if any(abs(s - k) < window for k in kept):
            continue
        kept.append(s)
        parts.append(("…" if s else "") + text[s:e].strip(" ") + ("…" if e < len(text) else ""))
    joined = "\n\n---\n\n".join(parts)
    return joined[:cap], len(joined) > cap


def test_keyword_context(spark):
    r = np.random.default_rng(3)
    words = ["pike", "Pike", "walleye", "limit", "season", "the", "zone", "open"]
    texts = [" ".join(r.choice(words[2:] if i % 5 == 0 else words, 900, p=None)) for i in range(12)]
    texts = [t.replace("Pike", "Pike" if i % 2 else "open") for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["c"] for x in df.select("i", X.keyword_context(F.col("t"), F.lit("pike")).alias("c")).collect()}
    for i, t in enumerate(texts):
        want = context(t, "pike")
        if want is None:
            assert got[i]["text"].startswith(t[:2000]) and "not found by exact name" in got[i]["text"]
        else:
            assert (got[i]["text"], got[i]["truncated"]) == want


def test_tags_and_chunks(spark):
    row = spark.range(1).select(
        X.tag_species(F.lit("Big Smallmouth and bass, some pike")).alias("a"),
        X.tag_species(F.lit("just bass")).alias("b"),
        X.tag_places(F.lit("Near Guelph on the Grand River")).alias("p"),
        X.zone_chunks(F.lit("intro Fisheries Management Zone 3 short ZONE 25 skip FMZ 12 last")).alias("z"),
        X.year_label(F.lit("PWQMN 2021-2022 data")).alias("y"), X.slug(F.lit("--Esox Lucius!")).alias("s")).first()
    assert row["a"] == ["smallmouth bass", "northern pike"] and row["b"] == ["bass"]
    assert row["p"] == ["grand river", "guelph"]
    assert [(c["zone"], c["text"]) for c in row["z"]] == [
        (3, "Fisheries Management Zone 3 short"), (12, "FMZ 12 last")]
    assert (row["y"], row["s"]) == ("2021_2022", "esox_lucius")


def test_search_ranks_and_filters(spark):
    d = spark.createDataFrame([(1, "walleye walleye river"), (2, "walleye lake"), (3, "river only"),
                               (4, "walleyes river")], "i int, t string")
    assert [r["i"] for r in Se.search(d, "i", F.col("t"), "Walleye").collect()] == [1, 2]
    assert [r["i"] for r in Se.search(d, "i", F.col("t"), "walleye river").collect()] == [1]
    assert [r["i"] for r in Se.search(d, "i", F.col("t"), "walleye", 1, F.col("i") > 1).collect()] == [2]
    marks = spark.createDataFrame([(1, "wow !! big"), (2, "none"), (3, "!!")], "i int, t string")
    assert [r["i"] for r in Se.search(marks, "i", F.col("t"), "!!").collect()] == [1, 3]
    assert Se.search(marks, "i", F.col("t"), "  ").count() == 0
