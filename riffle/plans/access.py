"""How reachable a stream segment is: polygons it lies in and tagged points around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.operators import spatial as S
from riffle.operators.aggregates import lookup, with_min_max
from riffle.operators.joins import banded
from riffle.session import cut, together

# Modifier per park type, bonuses per access type, road bands in km.
PARK_MODIFIERS = {
    "Recreational": 0.3, "Waterway": 0.2, "Natural Environment": 0.1, "Cultural Heritage": 0.0,
    "Nature Reserve": -0.3, "Wilderness": -0.4,
}
CROWN_BONUS = 0.3
HALF_KM_BONUSES = {
    "building": (["building"], 0.1),
    "fishing": (["fishing_spot"], 0.3),
    "park_point": (["park", "conservation_area", "public_land"], 0.1),
    "parking": (["parking"], 0.1),
}
ONE_KM_BONUSES = {"boat": (["boat_launch"], 0.2)}
ROAD_BANDS = [(0.2, 0.2), (0.5, 0.1), (1.0, 0.0), (30.0, -0.2)]
ROAD_REACH_DEG = 0.30


def bonus_within(segments: DataFrame, access: DataFrame, km: float,
                 bonuses: dict[str, tuple[list[str], float]],
                 at=("lat", "lng")) -> DataFrame:
    """A bonus column per entry: granted when any point of its types is within ``km``.

    All types of one radius share a single proximity pass through per-type counts.
    """
    wanted = sorted({k for kinds, _ in bonuses.values() for k in kinds})
    points = access.where(F.col("access_type").isin(wanted))
    counts = {f"_n_{n}": F.col("access_type").isin(kinds).cast("bigint")
              for n, (kinds, _) in bonuses.items()}
    out = S.with_radius_sums(segments, points, km / geo.KM_PER_DEGREE, S.DEGREES, counts,
                             left_at=at)
    return out.withColumns({
        n: F.when(F.col(f"_n_{n}") > 0, F.lit(bonus)).otherwise(F.lit(0.0))
        for n, (_, bonus) in bonuses.items()
    }).drop(*counts)


def _attach(df: DataFrame, found: DataFrame, at, columns: dict) -> DataFrame:
    lat, lng = at
    joined = df.join(found, (df[lat] == found["l_lat"]) & (df[lng] == found["l_lng"]), "left")
    return joined.withColumns(columns).drop("l_lat", "l_lng", "best")


def with_park_modifier(segments: DataFrame, parks: DataFrame, ring: str = "ring",
                       at=("lat", "lng")) -> DataFrame:
    """Modifier of the park the point lies in; the highest park_id wins where parks overlap."""
    best = F.struct(F.col("park_id"), F.col("park_type"))
    found = S.containing_polygons(segments, parks, ring, best, at)
    return _attach(segments, found, at, {
        "park_modifier": lookup(PARK_MODIFIERS, F.coalesce(F.col("best.park_type"), F.lit("")), 0.0)
    })


def with_crown_flag(segments: DataFrame, crown: DataFrame, ring: str = "ring",
                    at=("lat", "lng")) -> DataFrame:
    found = S.containing_polygons(segments, crown, ring, F.lit(1), at)
    return _attach(segments, found, at, {"is_crown_land": F.col("best").isNotNull()})


def raw_scores(segments: DataFrame, access: DataFrame, parks: DataFrame, crown: DataFrame,
               at=("lat", "lng")) -> DataFrame:
    """Sum of all modifiers, clipped to 0..2."""
    roads = access.where(F.col("access_type").isin("road", "parking"))
    # every modifier depends on the place alone: compute each from the distinct places
    lat, lng = at
    places = cut(segments.select(*at).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct())
    parts = together(
        lambda: with_park_modifier(places, parks, at=at),
        lambda: with_crown_flag(places, crown, at=at),
        lambda: S.with_nearest(places, roads, S.DEGREES, "osm_id", bound=ROAD_REACH_DEG, left_at=at,
                               distance="_road", prefix="_rd_"),
        lambda: bonus_within(places, access, 0.5, HALF_KM_BONUSES, at),
        lambda: bonus_within(places, access, 1.0, ONE_KM_BONUSES, at),
    )
    out = segments
    for part in parts:
        out = out.join(part, list(at), "left")
    out = out.fillna(False, ["is_crown_land"]).fillna(
        0.0, ["park_modifier", *HALF_KM_BONUSES, *ONE_KM_BONUSES])
    road = banded(F.col("_road") * geo.KM_PER_DEGREE, ROAD_BANDS, 0.0)
    total = (
        F.lit(1.0) + F.col("park_modifier")
        + F.when(F.col("is_crown_land"), F.lit(CROWN_BONUS)).otherwise(F.lit(0.0)) + road
        + sum((F.col(c) for c in [*HALF_KM_BONUSES, *ONE_KM_BONUSES]), F.lit(0.0))
    )
    keep = [*segments.columns, "is_crown_land"]
    clipped = F.least(F.greatest(F.round(total, 9), F.lit(0.0)), F.lit(2.0))
    return out.withColumn("access_raw", clipped).select(*keep, "access_raw")


def access_scores(segments, access, parks, crown, at=("lat", "lng")) -> DataFrame:
    """Access score in 0..1 over all segments, with the crown land flag."""
    # the bounds and the rows read the same result: write it once
    raw = cut(raw_scores(segments, access, parks, crown, at))
    return with_min_max(raw, "access_raw", "access_score")
