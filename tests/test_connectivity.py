"""Bounded searches for connected records, and barriers of all species from one search."""

from pyspark.sql import functions as F

from riffle.operators import graph as G


def stem(spark, n, first=0):
    kinds = F.when(F.col("id") == 5004, "Falls").when(F.col("id") == 4995, "Rapids").when(F.col("id") == 4993, "Sea Lamprey Barrier").when(F.col("id") == 5001, "Weir")
    return spark.range(first, first + n).select(
        F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("id").alias("ogf_id"), F.lit("stem").alias("name"), F.lit(0.5).alias("km"), kinds.alias("barrier_type"))


def counted(monkeypatch):
    calls, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: calls.append(1) or plain(df))
    return calls


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_near_targets_take_a_few_rounds_on_a_long_stem(spark, monkeypatch):
    calls = counted(monkeypatch)
    got = {r.node: r for r in G.barrier_labels(stem(spark, 10_000), nodes(spark, 5000), nodes(spark, 4990, 5006, 5006)).collect()}
    assert len(calls) < 10 and len(got) < 40
    assert (got[4990].hops, got[4990].path_km, got[4990].rapids, got[4990].lamprey, got[4990].falls) == (10, 5.0, 5, 7, None)
    assert (got[5006].hops, got[5006].falls) == (6, 5)


def test_targets_in_other_networks_are_given_up(spark, monkeypatch):
    calls = counted(monkeypatch)
    edges = stem(spark, 400).unionByName(stem(spark, 3, first=9000))
    got = G.barrier_labels(edges, nodes(spark, 0), nodes(spark, 3, 9001, 77_777, None)).collect()
    assert {3, 24} <= {r.node for r in got} and 9001 not in {r.node for r in got}
    assert len(got) < 60 and len(calls) < 60  # the whole stem would take 100 rounds


def test_what_blocks_depends_on_the_species(spark):
    paths = G.barrier_labels(stem(spark, 12, first=4989), nodes(spark, 5000), nodes(spark, 4990))
    for species, want in (("creek chub", "Rapids"), ("brook trout", None), ("sea lamprey", "Rapids"), (None, None)):
        got = {r.node: r.b for r in paths.select("node", G.first_blocking(F.lit(species).cast("string")).alias("b")).collect()}
        assert got[4990] == want and got[4996] is None
    falls = G.paths_from(stem(spark, 8, first=5000), nodes(spark, 5000), F.lit("brook trout")).where("node = 5007").first()
    assert falls.blocking_barrier == "Falls" and falls.hops == 7


def test_no_targets_and_no_sources(spark):
    edges = stem(spark, 5)
    assert G.barrier_labels(edges, nodes(spark)).count() == 0
    assert {r.node for r in G.barrier_labels(edges, nodes(spark, 2), nodes(spark)).collect()} <= set(range(6))
