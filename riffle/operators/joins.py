"""Joins built on the grid and on exact keys: soft labels, proximity scores, name overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.operators import spatial as S
from riffle.session import cut


def soft_labels(occurrences: DataFrame, segments: DataFrame, key: str = "ogf_id",
                spread_deg: float = 0.198, snap_deg: float = 0.09,
                obscured: str = "is_obscured") -> DataFrame:
    """Presence weight per segment.

    A precise record puts weight 1 on its nearest segment within ``snap_deg``. An obscured record
    spreads weight 1 evenly over all segments within ``spread_deg``, or puts it on the nearest one
    when there is none. The even spread is computed from both ends: first the number of segments
    around each record, then per segment the sum of 1/n over the records around it, so that no
    list of (record, segment) pairs is ever produced.
    """
    places = cut(occurrences.groupBy("lat", "lng", F.col(obscured).alias("_vague")).agg(F.count("*").alias("w")))
    vague = places.where(F.col("_vague")).drop("_vague")
    exact = places.where(~F.col("_vague")).drop("_vague")
    around = cut(S.with_radius_count(vague, segments, spread_deg, S.DEGREES, "n"))
    shared = around.where(F.col("n") > 0)
    alone = around.where(F.col("n") == 0)
    spread = S.with_radius_sums(
        segments.select(key, "lat", "lng"), shared, spread_deg, S.DEGREES,
        {"weight": F.col("w") / F.col("n")},
    ).where(F.col("weight") > 0).select(key, "weight")
    snapped = S.with_nearest(exact, segments, S.DEGREES, key, bound=snap_deg, how="inner").select(
        F.col(f"near_{key}").alias(key), F.col("w").cast("double").alias("weight"))
    lone = S.with_nearest(alone, segments, S.DEGREES, key, how="inner").select(
        F.col(f"near_{key}").alias(key), F.col("w").cast("double").alias("weight"))
    return spread.unionByName(snapped).unionByName(lone).groupBy(key).agg(
        F.sum("weight").alias("weight"))


def banded(km: Column, bands: list[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first band whose upper limit the distance reaches; null distances fall out."""
    out = None
    for limit, value in bands:
        hit = km <= limit
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _grams(names: DataFrame, steps: Column) -> DataFrame:
    """id, k and hash of the distinct substrings of 2^k characters of each name, for each k in ``steps``: as many rows
    as the name has characters for each k."""
    size = F.expr("shiftleft(1, k)")
    each = names.withColumn("k", F.explode(steps)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("name") - size + 1)))
    return each.select("id", "k", F.xxhash64(F.substring(F.col("name"), F.col("_i"), size)).alias("h")).distinct()


def containments(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id) of all names of ``texts`` that contain a name of ``patterns``; both hold id and name, and
    names are not empty.

    A pattern is looked up by one substring, of the greatest power of two of characters that it holds, that the fewest
    texts have. What is found is then held against the whole pattern. A pattern with a substring that no text has is
    given up at once.
    """
    top = F.floor(F.log2(F.length("name"))).cast("int")
    asked = patterns.agg(F.collect_set(top)).scalar()  # 31 powers at most
    mine = cut(_grams(texts, F.array_intersect(F.sequence(F.lit(0), top), asked)))
    theirs = _grams(patterns, F.array(top))
    whole = theirs.groupBy("id").agg(F.count("*").alias("_all"))
    met = theirs.join(mine.groupBy("k", "h").agg(F.count("*").alias("n")), ["k", "h"])
    rarest = met.groupBy("id").agg(F.count("*").alias("_met"), F.min_by(F.struct("k", "h"), F.struct("n", "h")).alias("g"))
    rarest = rarest.join(whole, "id").where("_met = _all").select(F.col("id").alias("pattern_id"), "g.k", "g.h")
    pairs = rarest.join(mine.withColumnRenamed("id", "text_id"), ["k", "h"]).select("text_id", "pattern_id")
    named = pairs.join(texts.select(F.col("id").alias("text_id"), F.col("name").alias("_t")), "text_id").join(
        patterns.select(F.col("id").alias("pattern_id"), F.col("name").alias("_p")), "pattern_id")
    return named.where(F.contains("_t", "_p")).select("text_id", "pattern_id")


def without_name_overlap(items: DataFrame, name: str, visited: DataFrame,
                         visited_name: str) -> DataFrame:
    """Drop items whose name contains a visited name or is contained in one, ignoring case. Unnamed items stay; an
    empty name overlaps with nothing."""
    def names(df: DataFrame, c: str) -> DataFrame:
        lowered = df.select(F.lower(c).alias("name")).where("name <> ''").distinct()
        return cut(lowered.select(F.md5("name").alias("id"), "name"))

    mine, theirs = names(items, name), names(visited, visited_name)
    hit = containments(mine, theirs).select(F.col("text_id").alias("_id")).unionByName(
        containments(theirs, mine).select(F.col("pattern_id").alias("_id"))).distinct()
    return items.join(hit, F.md5(F.lower(items[name])) == hit["_id"], "left_anti")


def merge_species_sources(inat: DataFrame, gbif: DataFrame) -> DataFrame:
    """Per species: counts of both sources, the second one's record kinds, a common name."""
    a = inat.groupBy("species").agg(
        F.count("*").alias("inat_count"), F.min("common_name").alias("_ci"))
    b = gbif.groupBy("species").agg(
        F.count("*").alias("gbif_count"),
        F.array_sort(F.collect_set("basis_of_record")).alias("basis"),
        F.min("common_name").alias("_cg"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "species", "full_outer").select(
        "species", F.coalesce("inat_count", zero).alias("inat_count"),
        F.coalesce("gbif_count", zero).alias("gbif_count"),
        F.coalesce("basis", F.array().cast("array<string>")).alias("basis"),
        F.coalesce("_cg", "_ci").alias("common_name"))


def nearest_in_box(few: DataFrame, right: DataFrame, deg: float, few_key: str, right_key: str,
                   carry: list[str], few_at=("lat", "lng"), right_at=("lat", "lng")) -> DataFrame:
    """Nearest right row (great circle) inside the square of ``deg`` around each of a few rows.

    ``few`` must come out of a limit: it is broadcast, and the right table streams past it with a
    map-side minimum. Columns: ``few_key``, km, ``right_key``, ``carry``, at_lat, at_lng.
    """
    joined = _box_candidates(few, right, deg, few_key, [right_key, *carry], few_at, right_at)
    km = geo.haversine_km("f_lat", "f_lng", "r_lat", "r_lng")
    best = joined.groupBy(few_key).agg(F.min(F.struct(
        km.alias("km"), F.col(f"r_{right_key}").alias("k"),
        *[F.col(f"r_{c}").alias(c) for c in carry],
        F.col("r_lat").alias("at_lat"), F.col("r_lng").alias("at_lng"))).alias("m"))
    return best.select(few_key, "m.km", F.col("m.k").alias(right_key),
                       *[f"m.{c}" for c in carry], "m.at_lat", "m.at_lng")


def _box_candidates(few, right, deg, few_key, columns, few_at, right_at) -> DataFrame:
    size = deg * (1 + 1e-9)
    cell = lambda c: F.floor(F.col(c) / size)
    asked = few.select(few_key, F.col(few_at[0]).alias("f_lat"), F.col(few_at[1]).alias("f_lng"))
    asked = asked.withColumn("cy", F.explode(F.sequence(cell("f_lat") - 1, cell("f_lat") + 1)))
    asked = asked.withColumn("cx", F.explode(F.sequence(cell("f_lng") - 1, cell("f_lng") + 1)))
    rows = right.select(
        F.col(right_at[0]).alias("r_lat"), F.col(right_at[1]).alias("r_lng"),
        *[F.col(c).alias(f"r_{c}") for c in columns]
    ).withColumn("cy", cell("r_lat")).withColumn("cx", cell("r_lng"))
    return rows.join(F.broadcast(asked), ["cy", "cx"]).where(
        geo.in_box("r_lat", "r_lng", F.col("f_lat"), F.col("f_lng"), deg))


def in_box_of(few: DataFrame, right: DataFrame, deg: float, few_key: str, columns: list[str],
              few_at=("lat", "lng"), right_at=("lat", "lng")) -> DataFrame:
    """Right rows inside the square around each of a few (limited) rows."""
    found = _box_candidates(few, right, deg, few_key, columns, few_at, right_at)
    return found.select(few_key, *[F.col(f"r_{c}").alias(c) for c in columns],
                        F.col("r_lat").alias("at_lat"), F.col("r_lng").alias("at_lng"))


def named_stream_label(name: Column, km: Column) -> Column:
    return F.when(name.isNotNull(), F.format_string("%s (%.1fkm)", name, km))


def distance_text(km: Column) -> Column:
    return F.when(km < 1.0, F.concat(F.floor(km * 1000).cast("string"), F.lit("m"))).otherwise(
        F.format_string("%.1fkm", km))


# Wording of access types.
ACCESS_LABELS = {
    "fishing_spot": "Fishing spot", "boat_launch": "Boat launch",
    "conservation_area": "Conservation area", "park": "Park",
}


def road_label(kind: Column, km: Column, direction: Column) -> Column:
    what = F.when(kind == "parking", "Parking area").otherwise("Road")
    return F.when(kind.isNotNull(), F.concat_ws(" ", what, distance_text(km), direction))


def access_label(kind: Column, km: Column) -> Column:
    what = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    for k, v in ACCESS_LABELS.items():
        what = F.when(kind == k, F.lit(v)).otherwise(what)
    return F.when(kind.isNotNull(), F.concat_ws(" ", what, distance_text(km)))
