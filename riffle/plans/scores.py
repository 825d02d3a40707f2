"""Untapped potential: habitat, pressure, access, structure and remoteness in one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import likely_culverted
from riffle.operators import joins as J
from riffle.operators import spatial as S
from riffle.operators.aggregates import with_log_max
from riffle.operators.ranking import top_per_group, top_two
from riffle.plans.species import common_name, resolve
from riffle.session import cut

FEATURE_DEFAULTS = {
    "watercourse_name": ("string", ""), "watercourse_type": ("string", ""),
    "observation_density_25km": ("bigint", 0), "is_confluence_segment": ("boolean", False),
    "connected_to_waterbody": ("boolean", False),
    "distance_to_nearest_confluence_km": ("double", None),
    "nearest_waterbody_distance_m": ("double", None), "substrate_category": ("string", None),
}
MODES = {"balanced": "untapped_score_balanced", "easy_access": "untapped_score_easy",
         "adventure": "untapped_score_adventure"}
SEEN_FACTOR = 0.3
TRIP_SNAP_KM = 0.5
HABITAT_FLOOR = 0.35


def habitat_scores(predictions: DataFrame, species: str | None = None) -> DataFrame:
    rows = predictions
    if species:
        rows = rows.where(F.lower("species") == resolve(species).lower())
    return rows.groupBy("ogf_id").agg(F.avg("prob").alias("habitat_score"))


def structural_bonus() -> Column:
    conf = F.coalesce(F.col("is_confluence_segment"), F.lit(False))
    near = ~conf & F.coalesce(F.col("distance_to_nearest_confluence_km") < 0.5, F.lit(False))
    joined = F.coalesce(F.col("connected_to_waterbody"), F.lit(False))
    return F.least(
        F.lit(1.0) + F.when(conf, 0.4).otherwise(0.0) + F.when(near, 0.2).otherwise(0.0)
        + F.when(joined, 0.3).otherwise(0.0), F.lit(2.0))


def remoteness(density="observation_density_25km") -> Column:
    d = F.col(density)
    return F.when(d == 0, 1.5).when((d > 0) & (d < 5), 1.25).otherwise(1.0)


def sampling_floor() -> Column:
    """Habitat suitable on paper but never visited is not scored below the floor."""
    unsampled = (
        (F.col("observation_density_25km") == 0) & (F.col("stream_order") >= 3)
        & F.col("substrate_category").isin("coarse", "mixed")
    )
    return F.when(F.coalesce(unsampled, F.lit(False)), F.greatest(
        F.col("habitat_score"), F.lit(HABITAT_FLOOR))).otherwise(F.col("habitat_score"))


def mode_score(mode: str) -> Column:
    h, p, a = F.col("habitat_score"), F.col("observation_pressure"), F.col("access_score")
    base = h * (1 - p)
    if mode == "easy_access":
        base = base * a
    elif mode == "adventure":
        base = base * (1 - a + 0.1)
    return base * structural_bonus() * remoteness()


def _with_feature_defaults(features: DataFrame) -> DataFrame:
    have = dict(features.dtypes)
    return features.withColumns({
        c: (F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c)).cast(kind)
        if c in have else F.lit(d).cast(kind)
        for c, (kind, d) in FEATURE_DEFAULTS.items()})


def untapped_potential(features: DataFrame, access: DataFrame, predictions: DataFrame,
                       species: str | None = None, mode: str = "balanced") -> DataFrame:
    """All three mode scores per fishable segment; the chosen mode is the main score.

    ``features`` and ``access`` are keyed by ogf_id (access_score, is_crown_land).
    """
    base = _with_feature_defaults(features).where(F.col("watercourse_type") != "Virtual Flow")
    base = cut(base)  # read by the maximum and by the rows
    base = with_log_max(base, "observation_density_25km", "observation_pressure")
    out = base.join(habitat_scores(predictions, species), "ogf_id", "left").join(
        access.select("ogf_id", "access_score", "is_crown_land"), "ogf_id", "left")
    out = out.withColumns({
        "habitat_score": F.coalesce("habitat_score", F.lit(0.0)),
        "access_score": F.coalesce("access_score", F.lit(0.5)),
        "observation_pressure": F.coalesce("observation_pressure", F.lit(0.0)),
    })
    out = out.withColumn("habitat_score", sampling_floor())
    out = out.withColumns({name: mode_score(m) for m, name in MODES.items()})
    return out.withColumn("untapped_score", F.col(MODES[mode]))


def seen_segments(dismissed: DataFrame, trips: DataFrame, segments: DataFrame,
                  at=("lat", "lng")) -> DataFrame:
    """Dismissed segments and those a trip location snaps to, flagged ``seen``."""
    snapped = S.nearest(trips, segments, S.KM_SCALED, "ogf_id", bound=TRIP_SNAP_KM, right_at=at)
    ids = dismissed.select("ogf_id").unionByName(snapped.select("ogf_id")).distinct()
    return ids.withColumn("seen", F.lit(True))


def seen_penalty(flag: str) -> Column:
    return F.when(F.coalesce(F.col(flag), F.lit(False)), SEEN_FACTOR).otherwise(1.0)


# --- sentences ------------------------------------------------------------------------------

def access_note() -> Column:
    return (
        F.when(F.col("is_crown_land"), "Crown land — public access generally permitted for fishing. "
               "Verify no specific restrictions.")
        .when(F.col("access_score") < 0.3,
              "⚠️ Access not verified — segment may cross private land. Check Ontario Crown Land map "
              "at geohub.lio.gov.on.ca before visiting. Low road access + private land = "
              "trespassing risk.")
        .otherwise("Road or park access nearby — verify public right of way.")
    )


def structural_note() -> Column:
    wb = F.col("nearest_waterbody_distance_m")
    return (
        F.when(F.col("is_confluence_segment"), "Confluence point — multiple streams meet here. "
               "High fish congregation probability.")
        .when(F.col("connected_to_waterbody") & wb.isNotNull(), F.concat(
            F.lit("Stream connects to nearby water body within "), F.floor(wb).cast("string"),
            F.lit("m — likely pool or pond where fish stack.")))
        .when(F.col("distance_to_nearest_confluence_km") < 0.5,
              "Within 500m of a stream confluence — fish often hold in this zone.")
        .otherwise("No structural features detected from mapped data — verify on satellite view.")
    )


def habitat_summary() -> Column:
    """Measured habitat properties joined by dots."""
    known = lambda c, text: F.when(
        F.coalesce(F.col(c), F.lit("")).isin("", "unknown"), F.lit(None)
    ).otherwise(F.concat(F.col(c), F.lit(text)))
    parts = F.concat_ws(" · ", known("thermal_regime", " thermal regime"),
                        known("substrate_category", " substrate"),
                        known("ept_quality", " EPT quality"))
    return F.when(parts == "", "Habitat features not measured at this location — field verification "
                  "needed.").otherwise(F.concat(parts, F.lit(".")))


def connectivity_note(stream: Column, species: Column) -> Column:
    """``species`` is an array of names, ``stream`` a 'Name (x.xkm)' label."""
    name = F.trim(F.split_part(stream, F.lit("("), F.lit(1)))
    text = F.concat(
        F.lit("Connected to "), name, F.lit(" where "),
        F.array_join(F.slice(species, 1, 3), ", "),
        F.lit(" have been confirmed — tributary may hold the same species via natural dispersal."))
    return F.when(stream.isNotNull() & (F.size(species) > 0), text)


def exploration_note(species: str | None) -> Column:
    """Structure, identity, habitat, access and pressure in one paragraph."""
    name = F.nullif("watercourse_name", F.lit(""))
    stream = F.trim(F.split_part("nearest_named_stream", F.lit("("), F.lit(1)))
    ref = F.coalesce(name, stream)
    conf, wb = F.col("is_confluence_segment"), F.col("nearest_waterbody_distance_m")
    pooled = F.col("connected_to_waterbody") & wb.isNotNull()
    lead = (
        F.when(conf & ref.isNotNull(), F.concat(F.lit("Confluence point on "), ref, F.lit(
            " — check the pool below the junction.")))
        .when(conf, "Confluence point — check the pool below the junction.")
        .when(pooled, F.concat(F.lit("Creek connects to water body "), F.floor(wb).cast("string"),
                               F.lit("m away — fish likely stacking at the transition.")))
        .when(name.isNotNull(), F.concat(name, F.lit(".")))
        .when(stream.isNotNull(), F.concat(F.lit("Unnamed tributary near "), stream, F.lit(".")))
        .otherwise("Unnamed stream segment.")
    )
    h, p = F.col("habitat_score"), F.col("observation_pressure")
    grade = F.when(h >= 0.6, "Strong").when(h >= 0.35, "Moderate").otherwise("Low")
    if species:
        habitat = F.concat(grade, F.lit(f" predicted habitat for {species}."))
    else:
        habitat = F.when(F.size("top_species") > 0, F.concat(
            grade, F.lit(" predicted habitat ("), F.array_join("top_species", " and "),
            F.lit(").")))
    pressure = (
        F.when(p < 0.15, "Very low observation pressure — likely underexplored.")
        .when(p < 0.35, "Low fishing pressure.").when(p < 0.6, "Moderate observation pressure.")
        .otherwise("High observation density in this area — popular water.")
    )
    verify = F.lit(
        "Verify before visiting: open mapbox_satellite for a pre-rendered satellite image with pin, "
        "google or bing to explore the surroundings. In Ontario: swoop_2025 shows 16cm leaf-off "
        "aerial imagery — best for confirming stream channel and bank access.")
    return F.concat_ws(
        " ", lead, habitat, F.concat(F.col("nearest_road_access"), F.lit(".")),
        F.concat(F.col("nearest_osm_access"), F.lit(" nearby.")), pressure, verify)


# --- questions ------------------------------------------------------------------------------

def nearby_species(few: DataFrame, sources: list[DataFrame], radius_km: float = 5.0,
                   k: int = 5, key: str = "ogf_id", at=("centroid_lat", "centroid_lng")):
    """The k most recorded species around each of a few segments, as an array."""
    deg = radius_km / geo.KM_PER_DEGREE
    found = None
    for source in sources:
        named = source.withColumn("_name", F.coalesce(
            F.nullif("common_name", F.lit("")), F.nullif("species", F.lit(""))))
        part = J.in_box_of(few, named, deg, key, ["_name"], at).where(
            F.col("_name").isNotNull()).groupBy(key, "_name").agg(F.count("*").alias("n"))
        found = part if found is None else found.unionByName(part)
    counted = found.groupBy(key, "_name").agg(F.sum("n").alias("n"))
    best = top_per_group(counted, [key], [F.desc("n"), F.col("_name")], k, "rk")
    return best.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rk", "_name"))), lambda x: x["_name"]
    ).alias("nearby_species"))


def enrich(few: DataFrame, segments: DataFrame, access: DataFrame, predictions: DataFrame,
           named_radius_km: float = 10.0, species: str | None = None) -> DataFrame:
    """Neighbourhood columns for a limited result: named stream, road, tagged spot, top species."""
    at = ("centroid_lat", "centroid_lng")
    deg = lambda km: km / geo.KM_PER_DEGREE
    named = segments.where(F.coalesce("name", F.lit("")) != "")
    stream = J.nearest_in_box(
        few, named.withColumnRenamed("ogf_id", "near_id"), deg(named_radius_km), "ogf_id",
        "near_id", ["name"], at
    ).select("ogf_id", J.named_stream_label(F.col("name"), F.col("km")).alias(
        "nearest_named_stream"))
    close = J.nearest_in_box(
        few, named.withColumnRenamed("ogf_id", "near_id"), deg(3.0), "ogf_id", "near_id", ["name"], at
    ).select("ogf_id", J.named_stream_label(F.col("name"), F.col("km")).alias("named_stream_3km"))
    roads = access.where(F.col("access_type").isin("road", "parking"))
    road = J.nearest_in_box(few, roads, deg(2.0), "ogf_id", "osm_id", ["access_type"], at)
    road = road.join(F.broadcast(few.select("ogf_id", *at)), "ogf_id").select(
        "ogf_id", J.road_label(F.col("access_type"), F.col("km"), geo.bearing(
            *at, "at_lat", "at_lng")).alias("nearest_road_access"))
    spots = access.where(F.col("access_type").isin(
        "fishing_spot", "boat_launch", "conservation_area", "park"))
    spot = J.nearest_in_box(few, spots, deg(1.0), "ogf_id", "osm_id", ["access_type"], at).select(
        "ogf_id", J.access_label(F.col("access_type"), F.col("km")).alias("nearest_osm_access"))
    mine = predictions.join(F.broadcast(few.select("ogf_id")), "ogf_id", "left_semi")
    two = top_two(mine, "ogf_id", "species", "prob").select(
        "ogf_id", F.array_compact(F.array(
            common_name(F.col("top1")), common_name(F.col("top2")))).alias("top_species"))
    out = few
    for part in (stream, close, road, spot, two):
        out = out.join(part, "ogf_id", "left")
    out = out.withColumn("top_species", F.coalesce(
        "top_species", F.array().cast("array<string>")))
    return out.withColumns({
        "access_note": access_note(), "structural_note": structural_note(),
        "exploration_note": exploration_note(species),
        "maps_urls": geo.map_links("centroid_lat", "centroid_lng"),
    })


def find_untapped_water(untapped: DataFrame, predictions: DataFrame, lat: float, lng: float,
                        radius_km: float = 50.0, species: str | None = None,
                        min_stream_order: int = 3, limit: int = 10,
                        exclude_likely_culverted: bool = True) -> DataFrame:
    """Best untapped segments around a place, no two within 500 m. Call ``enrich`` on the result."""
    rows = untapped.where(
        geo.near("centroid_lat", "centroid_lng", lat, lng, radius_km)
        & (F.col("stream_order") >= min_stream_order))
    if exclude_likely_culverted:
        rows = rows.where(~likely_culverted("stream_order", "observation_density_25km"))
    if species:
        habitat = habitat_scores(predictions, species)
        rows = rows.drop("habitat_score").join(habitat, "ogf_id", "left").withColumn(
            "habitat_score", F.coalesce("habitat_score", F.lit(0.0)))
        rows = rows.withColumn("untapped_score", F.col("habitat_score")
                               * (1 - F.col("observation_pressure")) * F.col("access_score"))
    rows = rows.where(F.col("untapped_score") > 0)
    return S.thin_by_distance(rows, limit, 0.5, [], [F.desc("untapped_score"), F.col("ogf_id")],
                              "ogf_id", "centroid_lat", "centroid_lng")


def find_exploration_targets(untapped: DataFrame, predictions: DataFrame, seen: DataFrame,
                             lat: float, lng: float, radius_km: float = 50.0,
                             species: str | None = None, min_stream_order: int = 3,
                             limit: int = 5, mode: str = "balanced") -> DataFrame:
    """Like the above by mode, with segments already seen scored down."""
    rows = untapped.where(
        geo.near("centroid_lat", "centroid_lng", lat, lng, radius_km)
        & (F.col("stream_order") >= min_stream_order))
    if species:
        habitat = habitat_scores(predictions, species)
        rows = rows.drop("habitat_score").join(habitat, "ogf_id", "left").withColumn(
            "habitat_score", F.coalesce("habitat_score", F.lit(0.0)))
    rows = rows.join(seen, "ogf_id", "left").withColumn(
        "untapped_score", mode_score(mode) * seen_penalty("seen"))
    rows = rows.withColumn("seen", F.coalesce("seen", F.lit(False))).where("untapped_score > 0")
    out = S.thin_by_distance(rows, limit, 0.5, [], [F.desc("untapped_score"), F.col("ogf_id")],
                             "ogf_id", "centroid_lat", "centroid_lng")
    return out.withColumn("fmz", geo.fmz("centroid_lat", "centroid_lng"))
