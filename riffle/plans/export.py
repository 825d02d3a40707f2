"""Map data: filters of the map page, display tiers, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import outside_map_region
from riffle.operators.aggregates import rank_thresholds

CUTS = {"p95": 0.05, "p80": 0.20, "p60": 0.40, "p40": 0.60}
SCORES = ["untapped_score_balanced", "untapped_score_easy", "untapped_score_adventure"]
HOME_RADIUS_KM = 150.0


def map_filter(confluence_only: bool = False, waterbody_only: bool = False,
               min_order: int | None = None, species: str | None = None) -> Column:
    parts = []
    if confluence_only:
        parts.append(F.coalesce(F.col("is_confluence_segment"), F.lit(False)))
    if waterbody_only:
        parts.append(F.coalesce(F.col("connected_to_waterbody"), F.lit(False)))
    if min_order is not None:
        parts.append(F.col("stream_order").isNull() | (F.col("stream_order") >= min_order))
    if species:
        parts.append(F.coalesce(F.col("top1") == species, F.lit(False))
                     | F.coalesce(F.col("top2") == species, F.lit(False)))
    return geo.all_of(parts)


def tier(score: Column, p95: Column, p80: Column, p60: Column, p40: Column) -> Column:
    """Display tier 1 (best) to 5 from the score's thresholds."""
    return (F.when(score >= p95, 1).when(score >= p80, 2).when(score >= p60, 3)
            .when(score >= p40, 4).otherwise(5))


def probability_tier(p: Column) -> Column:
    return F.when(p > 0.70, 1).when(p > 0.50, 2).when(p > 0.30, 3).otherwise(4)


def species_probability(species: str) -> Column:
    """The selected species' probability where it is among the top two."""
    return F.when(F.col("top1") == species, F.col("top1_score")).when(
        F.col("top2") == species, F.col("top2_score"))


def region(untapped: DataFrame, home_lat: float, home_lng: float,
           radius_km: float = HOME_RADIUS_KM) -> DataFrame:
    inside = geo.within_haversine("centroid_lat", "centroid_lng", home_lat, home_lng, radius_km)
    return untapped.where(
        inside & ~outside_map_region("centroid_lat", "centroid_lng", "watercourse_type"))


def best_rows(untapped: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows, or the best ``limit`` of them."""
    if limit is None:
        return untapped
    return untapped.orderBy(F.desc("untapped_score_balanced"), "ogf_id").limit(limit)


def features(rows: DataFrame) -> DataFrame:
    """One GeoJSON feature text per row."""
    geometry = F.struct(
        F.lit("Point").alias("type"),
        F.array(F.round("centroid_lng", 5), F.round("centroid_lat", 5)).alias("coordinates"))
    props = [c for c in rows.columns if c not in ("centroid_lat", "centroid_lng")]
    return rows.select("ogf_id", F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"),
        F.struct(*props).alias("properties"))).alias("feature"))


def thresholds(rows: DataFrame, scores: list[str] | None = None) -> DataFrame:
    return rank_thresholds(rows, scores or SCORES, CUTS)


def write_geojson(rows: DataFrame, path: str) -> None:
    """Features as JSON lines, written in parallel, and their thresholds beside them."""
    features(rows).select(F.col("feature").alias("value")).write.mode("overwrite").text(
        f"{path}/features")
    thresholds(rows).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
