"""Is a species connected to this place, and what lies between?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import contains_ci
from riffle.operators import graph as G
from riffle.operators import spatial as S
from riffle.session import cut

SNAP_DEG = 0.009


def nearby_observations(inat: DataFrame, gbif: DataFrame, lat: float, lng: float,
                        radius_km: float, species: str | None) -> DataFrame:
    """Both sources in one shape, inside the box, optionally of one species."""
    a = inat.select(F.concat(F.lit("i"), F.col("observation_id").cast("string")).alias("obs_id"),
                    "species", "common_name", "lat", "lng", "place_guess")
    b = gbif.select(F.concat(F.lit("g"), F.col("gbif_key").cast("string")).alias("obs_id"),
                    "species", "common_name", "lat", "lng")
    rows = a.unionByName(b, allowMissingColumns=True).where(
        geo.near("lat", "lng", lat, lng, radius_km))
    if species:
        rows = rows.where(contains_ci("species", species) | contains_ci("common_name", species))
    return rows


def analyze(edges: DataFrame, positions: DataFrame, inat: DataFrame, gbif: DataFrame, lat: float,
            lng: float, species: str | None = None, radius_km: float = 20.0,
            snap_deg: float = SNAP_DEG, top: int = 3) -> DataFrame:
    """Connected records per species: path km and the first barrier the species cannot pass.

    Without a species, the most recorded ones around are taken. One breadth-first search from the
    question's node serves all species, and ends when it has met the node of every record.
    """
    records = nearby_observations(inat, gbif, lat, lng, radius_km, species)
    if species:
        records = records.withColumn("asked", F.lit(species))
    else:
        best = records.groupBy("species").agg(F.count("*").alias("n")).orderBy(
            F.desc("n"), "species").limit(top)
        # the best few are a table of ``top`` rows
        records = records.join(best.select("species"), "species", "left_semi").withColumn("asked", F.col("species"))
    d = geo.euclid("lat", "lng", F.lit(lat), F.lit(lng))
    start = positions.where(geo.in_box("lat", "lng", lat, lng, snap_deg) & (d <= snap_deg)).orderBy(
        d, "node").limit(1).select("node")
    snapped = cut(S.with_nearest(records, positions, S.DEGREES, "node", bound=snap_deg, how="inner"))
    targets = snapped.select(F.col("near_node").alias("node"))
    paths = G.barrier_labels(edges, start, targets)
    return snapped.join(paths, F.col("near_node") == F.col("node")).select(
        F.col("asked").alias("species"), "obs_id", "lat", "lng",
        F.coalesce(F.nullif("place_guess", F.lit("")), F.lit("nearby")).alias("place_guess"),
        F.round("path_km", 2).alias("distance_km"), G.first_blocking(F.col("asked")).alias("blocking_barrier"))


# Wording of barriers.
BARRIER_TEXT = {
    "Falls": "a waterfall that is impassable for this species",
    "Rapids": "rapids that may limit upstream movement for small-bodied fish",
    "Sea Lamprey Barrier": "a sea lamprey barrier (passable for most species)",
}


def narrative(connected: DataFrame) -> DataFrame:
    """Per species the closest open and the closest blocked record, and a sentence on each."""
    free = F.when(F.col("blocking_barrier").isNull(), F.struct("distance_km", "obs_id", "place_guess"))
    shut = F.when(F.col("blocking_barrier").isNotNull(), F.struct(
        "distance_km", "obs_id", "place_guess", "blocking_barrier"))
    g = connected.groupBy("species").agg(
        F.count("*").alias("records"), F.min(free).alias("free"), F.min(shut).alias("shut"))
    what = F.concat(F.lit("a "), F.col("shut.blocking_barrier"), F.lit(" barrier"))
    for k, v in BARRIER_TEXT.items():
        what = F.when(F.col("shut.blocking_barrier") == k, F.lit(v)).otherwise(what)
    name = F.initcap("species")
    open_text = F.when(F.col("free").isNotNull(), F.concat(
        name, F.format_string(" confirmed %.1fkm away near %s — no barriers detected on the "
                              "connecting reach. Stream connectivity is intact between that record "
                              "and this location.", "free.distance_km", "free.place_guess")))
    shut_text = F.when(F.col("shut").isNotNull(), F.concat(
        name, F.format_string(" also recorded %.1fkm away near %s, but ", "shut.distance_km",
                              "shut.place_guess"), what,
        F.lit(" lies on the intervening reach.")))
    return g.select(
        "species", "records", F.col("free.distance_km").alias("open_km"),
        F.col("shut.distance_km").alias("blocked_km"),
        F.col("shut.blocking_barrier").alias("nearest_barrier"),
        F.concat_ws(" ", open_text, shut_text).alias("summary"))
