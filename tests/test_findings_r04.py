"""Faults found in review, round 4: each test failed on the code before."""

import re

import pytest
from pyspark.sql import functions as F

from riffle.plans import features as Fe
from riffle.plans import jobs as J
from riffle.session import cut, small_broadcasts

LIMITS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def broadcasts(df):
    return len(re.findall("BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


def wide(spark, n):
    return cut(spark.range(n).select(F.col("id").alias("ogf_id"), F.xxhash64("id").alias(f"v{n}")))


def test_feature_matrix_job_broadcasts_small_tables_only(spark, tmp_path, monkeypatch):
    seen = {}

    def matrix(**kw):
        rows, small = wide(spark, 90_000), wide(spark, 50)
        out = rows.join(wide(spark, 80_000), "ogf_id").join(small, "ogf_id")
        seen["broadcasts"] = broadcasts(out)
        return out

    monkeypatch.setattr(Fe, "feature_matrix", matrix)
    monkeypatch.setattr(Fe, "coverage", lambda rows: rows)
    before = [spark.conf.get(key) for key in LIMITS]
    out = J.build_features(J.Store(spark, str(tmp_path)), None, {}, 2001)
    assert out.count() == 50
    assert seen["broadcasts"] == 1  # the table of 50 rows; that of 80,000 is far below Spark's own limit
    assert [spark.conf.get(key) for key in LIMITS] == before


def test_feature_maps_are_written_before_they_meet(spark, monkeypatch):
    cols = {c: "double" for c in Fe.COLUMNS[5:]} | {c: "string" for c in (
        "substrate_category", "thermal_regime", "ept_quality", "nearest_stocked_species")} | {c: "boolean" for c in (
        "is_stocked_within_5yr", "pwqmn_coverage", "is_confluence_segment")}
    cols = {c: k for c, k in cols.items() if c not in ("length_m", "flow_verified", "connected_to_waterbody")}

    def steps(*given, threads=6):
        assert len(given) == 9
        return [f() for f in given]

    def part(*names):
        return spark.range(3).select(F.col("id").alias("ogf_id"), *[F.lit(None).cast(cols[n]).alias(n) for n in names])

    def stub(*names):
        return lambda *a, **k: part(*names)

    monkeypatch.setattr(Fe, "together", steps)
    monkeypatch.setattr(Fe.G, "strahler", stub("stream_order"))
    monkeypatch.setattr(Fe, "confluence_features", stub("is_confluence_segment", "distance_to_nearest_confluence_km"))
    monkeypatch.setattr(Fe, "observation_features", stub("distance_to_nearest_observation_km", "observation_density_25km"))
    monkeypatch.setattr(Fe.G, "upstream_counts", stub("barrier_count_upstream"))
    monkeypatch.setattr(Fe, "station_medians", lambda readings: readings)
    monkeypatch.setattr(Fe, "from_stations", lambda e, p, s, k, names, snap_deg: part(*names.values()))
    monkeypatch.setattr(Fe.S, "with_nearest", lambda *a, **k: part("substrate_category").withColumnRenamed(
        "substrate_category", "near_substrate_class"))
    monkeypatch.setattr(Fe, "stocking_features", stub("is_stocked_within_5yr", "nearest_stocked_species"))
    monkeypatch.setattr(Fe, "water_features", stub("nearest_waterbody_distance_m"))
    segments = spark.sql("SELECT id AS ogf_id, id AS start_node, id + 1 AS end_node, 10.0D AS length_m, 'a' AS name, "
                         "'Stream' AS watercourse_type, true AS flow_verified, 'LINESTRING (0 0, 1 1)' AS geom_wkt FROM range(3)")
    at = spark.sql("SELECT 1L AS ogf_id, 1L AS node, 1L AS nearest_segment_ogf_id, 'Falls' AS barrier_type, 0.0D AS lat, 0.0D AS lng, "
                   "1L AS observation_id, 1L AS gbif_key")
    out = Fe.feature_matrix(segments, at, at, at, at, at, at, at, at, at, at, 2001)
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = [leaves.apply(i).nodeName() for i in range(leaves.size())]
    assert out.count() == 3 and len(kinds) == 10 and all(k.startswith("LogicalRelation") for k in kinds), kinds


def test_small_broadcasts_restores_after_overlapping_uses(spark):
    first, second = small_broadcasts(spark), small_broadcasts(spark)
    before = spark.conf.get(LIMITS[0])
    first.__enter__()
    assert spark.conf.get(LIMITS[0]) == "256k"
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(LIMITS[0]) == "256k"
    second.__exit__(None, None, None)
    assert spark.conf.get(LIMITS[0]) == before


@pytest.mark.parametrize("own", ["-1", "1k"])
def test_small_broadcasts_keeps_a_lower_limit(spark, own):
    before = spark.conf.get(LIMITS[0])
    try:
        spark.conf.set(LIMITS[0], own)
        with small_broadcasts(spark):
            assert spark.conf.get(LIMITS[0]) == own
        assert spark.conf.get(LIMITS[0]) == own
    finally:
        spark.conf.set(LIMITS[0], before)
