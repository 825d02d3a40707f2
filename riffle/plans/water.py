"""Water bodies near a place: fishable ones, convenience order, colonisation flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import NON_FISHABLE, at_least_if_known, since
from riffle.operators import spatial as S
from riffle.operators.joins import without_name_overlap
from riffle.operators.ranking import convenience_rank

ISOLATED_TYPES = ["pond", "reservoir"]
MIN_AREA_M2 = 50.0
MAX_RESULTS = 15
DISPERSAL_NOTE = (
    "Isolated water body with recent waterfowl activity. Cyprinid colonization via bird dispersal "
    "is scientifically plausible (PNAS 2020) — worth sampling even without stream connectivity."
)


def fishable(features: DataFrame) -> DataFrame:
    return features.where(
        ~F.col("feature_type").isin(NON_FISHABLE) & at_least_if_known("area_m2", MIN_AREA_M2))


def _count_in_box(left: DataFrame, right: DataFrame, metres: float, name: str) -> DataFrame:
    return S.with_radius_count(
        left, right, metres / geo.M_PER_DEGREE, S.box_metric(1.4), name)


def dispersal_flags(features: DataFrame, streams: DataFrame, birds: DataFrame, asof: str,
                    days: int = 30, stream_m: float = 200.0, bird_m: float = 500.0) -> DataFrame:
    """Ponds and reservoirs without a stream beside them but with recent birds."""
    recent = birds.where(since("observed_on", asof, days))
    places = features.where(F.col("feature_type").isin(ISOLATED_TYPES)).select("lat", "lng").distinct()
    out = features
    for part in (_count_in_box(places, streams, stream_m, "_streams"),
                 _count_in_box(places, recent, bird_m, "_birds")):
        out = out.join(part, ["lat", "lng"], "left")
    flag = (F.col("feature_type").isin(ISOLATED_TYPES) & (F.col("_streams") == 0)
            & (F.col("_birds") > 0))
    flag = F.coalesce(flag, F.lit(False))
    return out.withColumn("waterfowl_dispersal_flag", flag).drop("_streams", "_birds")


def nearby_water(features: DataFrame, lat: float, lng: float, radius_km: float = 25.0,
                 feature_type: str | None = None, visited: DataFrame | None = None,
                 visited_name: str = "location_name", limit: int = MAX_RESULTS) -> DataFrame:
    """Fishable water bodies around a place, the most convenient first."""
    near = fishable(features).where(geo.near("lat", "lng", lat, lng, radius_km))
    if feature_type:
        near = near.where(F.col("feature_type") == feature_type)
    if visited is not None:
        near = without_name_overlap(near, "name", visited, visited_name)
    km = geo.haversine_km(F.lit(lat), F.lit(lng), "lat", "lng")
    ranked = convenience_rank(near.withColumn("km", km), "km", "area_m2", limit, "osm_id")
    return ranked.withColumn("distance_km", F.round("km", 2)).drop("km")


def access_points(points: DataFrame, lat: float, lng: float, radius_km: float = 25.0,
                  limit: int = MAX_RESULTS) -> DataFrame:
    km = geo.haversine_km(F.lit(lat), F.lit(lng), "lat", "lng")
    return (
        points.where(geo.near("lat", "lng", lat, lng, radius_km))
        .withColumn("km", km).orderBy("km", "osm_id").limit(limit)
        .withColumn("distance_km", F.round("km", 2)).drop("km")
    )
