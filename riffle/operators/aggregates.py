"""Grouped summaries: medians, ratios, rollups, normalisation, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.operators.ranking import first_per_group
from riffle.session import cut


# Benthic families and orders that mark clean water.
EPT_FAMILIES = [
    "Baetidae", "Ephemerellidae", "Heptageniidae", "Siphlonuridae", "Leptophlebiidae", "Caenidae",
    "Ephemeridae", "Tricorythidae", "Polymitarcyidae", "Potamanthidae", "Neoephemeridae",
    "Isonychiidae", "Metretopodidae", "Ametropodidae",
    "Capniidae", "Chloroperlidae", "Leuctridae", "Nemouridae", "Perlidae", "Perlodidae",
    "Pteronarcyidae", "Taeniopterygidae",
    "Brachycentridae", "Glossosomatidae", "Hydropsychidae", "Hydroptilidae", "Lepidostomatidae",
    "Leptoceridae", "Limnephilidae", "Molannidae", "Odontoceridae", "Philopotamidae",
    "Phryganeidae", "Polycentropodidae", "Psychomyiidae", "Rhyacophilidae", "Sericostomatidae",
    "Uenoidae",
]
EPT_ORDERS = ["Ephemeroptera", "Plecoptera", "Trichoptera"]
PARAMETERS = ["do_mgl", "ph", "temp_c", "conductivity_us_cm", "turbidity_fnu"]
BASS_POOL = ["Micropterus nigricans", "Micropterus salmoides"]


def counts_desc(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def counts_as_text(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """'LABEL: n, LABEL: n' per group, most frequent first; labels come from a fixed vocabulary."""
    counted = df.groupBy(*group, key).agg(F.count("*").alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"))))
    text = F.array_join(F.transform(
        items, lambda s: F.concat(s["k"], F.lit(": "), (-s["o"]).cast("string"))), ", ")
    return counted.groupBy(*group).agg(text.alias("breakdown"))


def values_at(df: DataFrame, keys: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key: the value at each named 0-based ascending position.

    Equal values are first collapsed to counts, which are range-partitioned on key and value. Each
    piece adds up its counts apart, and one small row per (partition, key) carries the sum of the
    pieces before, so no task ever holds a whole group, however its values are spread.
    ``positions`` are expressions of ``n``, the group's size. Result: keys, name, v.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = cut(x.repartitionByRange(*keys, "v").withColumn("_part", F.spark_partition_id()))
    pieces = placed.groupBy("_part", *keys).agg(F.sum("c").alias("_size"))
    group, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part")
    pieces = pieces.select(
        "_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (F.sum("_size").over(along) - F.col("_size")).alias("_before"), F.sum("_size").over(group).alias("n"))
    # positions become columns here: an expression of one may hold a scalar subquery, which a lambda may not
    spots = {name: f"_at{i}" for i, name in enumerate(positions)}
    pieces = pieces.withColumns({spots[name]: p.cast("bigint") for name, p in positions.items()})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    end = F.sum("c").over(Window.partitionBy("_part", *keys).orderBy("v"))
    ends = placed.withColumn("_end", end).withColumnRenamed("_part", "_p").join(
        pieces, [F.col("_p") == F.col("_part"), *same]).withColumn("_end", F.col("_before") + F.col("_end"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.col(at).alias("pos")) for name, at in spots.items()])
    hit = F.filter(wanted, lambda t: (F.col("_end") > t["pos"]) & (F.col("_end") - F.col("c") <= t["pos"]))
    return ends.select(*keys, "v", F.explode(hit).alias("_t")).select(*keys, F.col("_t.name").alias("name"), "v")


def known_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median of each value column per key, nulls skipped; no row for a key without any value."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("param"), F.col(v).cast("double").alias("x")) for v in values
    ])).alias("s")).select(*keys, "s.param", "s.x")
    n = F.col("n")
    found = values_at(long, [*keys, "param"], "x",
                      {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    return found.groupBy(*keys).agg(*[F.avg(F.when(F.col("param") == v, F.col("v"))).alias(v) for v in values])


def exact_median(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The same with nulls for a key without a value."""
    none = df.select(*keys).distinct().select(*keys, *[F.lit(None).cast("double").alias(v) for v in values])
    both = known_medians(df, keys, values).unionByName(none)
    return both.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def station_medians(readings: DataFrame) -> DataFrame:
    """Per-station medians of the water quality values, with the station's first coordinates."""
    medians = known_medians(readings, ["station_id"], ["do_mgl", "ph", "conductivity_us_cm"])
    where = readings.groupBy("station_id").agg(
        F.min_by("lat", "record_id").alias("lat"), F.min_by("lng", "record_id").alias("lng"))
    return where.join(medians, "station_id", "left").select(
        "station_id", "lat", "lng", F.col("do_mgl").alias("do_median_mgl"),
        F.col("ph").alias("ph_median"),
        F.col("conductivity_us_cm").alias("conductivity_median_us_cm"))


def thermal_regime(mean_temp) -> Column:
    c = F.col(mean_temp) if isinstance(mean_temp, str) else mean_temp
    return F.when(c < 18, "coldwater").when(c <= 23, "coolwater").otherwise("warmwater")


# Note per thermal regime.
THERMAL_NOTES = {
    "coldwater": "Summer temps support brook trout, lake trout, and other salmonids. "
                 "Darters and sensitive cyprinids plausible.",
    "coolwater": "Suitable for walleye, pike, bass. "
                 "Marginal for salmonids — check for cold groundwater refugia.",
    "warmwater": "Carp, catfish, bass, sunfish. Too warm for sustained salmonid presence.",
    "unknown": "Insufficient temperature data to classify thermal regime.",
}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def thermal_summary(monthly: DataFrame, min_months: int = 3) -> DataFrame:
    """July and August water temperature per station, stations with enough months only."""
    # one row per (station, year) first, so a station with most of the rows is combined map-side
    yearly = (
        monthly.where(F.col("month").isin(7, 8) & F.col("mean_temp_c").isNotNull())
        .groupBy("station_id", "year")
        .agg(F.max("station_name").alias("station_name"), F.max("lat").alias("lat"),
             F.max("lng").alias("lng"), F.sum("mean_temp_c").alias("s"), F.count("*").alias("n"),
             F.max("max_temp_c").alias("mx"))
    )
    out = yearly.groupBy("station_id").agg(
        F.max("station_name").alias("station_name"), F.max("lat").alias("lat"),
        F.max("lng").alias("lng"), (F.sum("s") / F.sum("n")).alias("mean"),
        F.round(F.max("mx"), 2).alias("summer_max_c"), F.count("*").alias("years_of_data"),
        F.sum("n").alias("months"),
    ).where(F.col("months") >= min_months)
    regime = thermal_regime("mean")
    return out.select(
        "station_id", "station_name", "lat", "lng", F.round("mean", 2).alias("summer_mean_c"),
        "summer_max_c", regime.alias("thermal_regime"), "years_of_data",
        lookup(THERMAL_NOTES, regime, THERMAL_NOTES["unknown"]).alias("species_notes"))


def parameter_stats(readings: DataFrame, group: list[str] | None = None,
                    params: Sequence[str] = PARAMETERS) -> DataFrame:
    """min / median / max / count per parameter in long form, with summer temperature besides."""
    group = group or []
    summer = F.when(F.month("sampled_at").isin(6, 7, 8), F.col("temp_c"))
    wide = readings.withColumn("summer_temp_c", summer)
    names = [*params, "summer_temp_c"]
    long = wide.select(*group, F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value"))
        for p in names])).alias("x")).select(*group, "x.parameter", "x.value")
    long = long.where(F.col("value").isNotNull())
    keys = [*group, "parameter"]
    base = long.groupBy(*keys).agg(
        F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"),
        F.count("*").alias("n"))
    med = exact_median(long, keys, ["value"])
    return base.join(med, keys).select(
        *keys, "min", F.round("value", 2).alias("median"), "max", "n")


def station_summary(readings: DataFrame) -> DataFrame:
    return readings.groupBy("station_id").agg(
        F.min_by("station_name", "record_id").alias("station_name"),
        F.min_by("lat", "record_id").alias("lat"), F.min_by("lng", "record_id").alias("lng"),
        F.count("*").alias("reading_count"), F.min("sampled_at").alias("first_date"),
        F.max("sampled_at").alias("last_date"))


def is_ept(order="taxon_order", family="family") -> Column:
    fam = F.coalesce(F.trim(F.col(family)), F.lit(""))
    return fam.isin(EPT_FAMILIES) | (F.trim(F.col(order)).isin(EPT_ORDERS) & (fam == ""))


def habitat_quality(p: Column) -> Column:
    return F.when(p >= 0.5, "high").when(p >= 0.25, "moderate").otherwise("impaired")


def benthic_counts(taxa: DataFrame, visit="site_visit_id", count="n") -> DataFrame:
    """Clean-water and total counts and richness per visit; non-positive counts are ignored."""
    fam = F.coalesce(F.trim(F.col("family")), F.lit(""))
    taxon = F.when(fam != "", fam).otherwise(F.trim(F.col("taxon_order")))
    # one row per (visit, taxon) first: the distinct counts then need no second shuffle of raw rows
    per_taxon = (
        taxa.where(F.col(count) > 0).withColumn("taxon", taxon).withColumn("ept", is_ept())
        .groupBy(visit, "taxon")
        .agg(F.sum(count).alias("total"), F.sum(F.when(F.col("ept"), F.col(count))).alias("ept"),
             F.max(F.col("ept")).alias("any_ept"))
    )
    return per_taxon.groupBy(visit).agg(
        F.coalesce(F.sum("ept"), F.lit(0.0)).alias("ept_count"), F.sum("total").alias("total_count"),
        F.count_if("any_ept").alias("ept_richness"), F.count("*").alias("total_taxa_richness"))


def benthic_samples(taxa: DataFrame, visits: DataFrame) -> DataFrame:
    """Counts joined to visit data; a visit missing there keeps its own id as site code."""
    counts = benthic_counts(taxa).where(F.col("total_count") > 0)
    share = F.col("ept_count") / F.col("total_count")
    meta = visits.select("site_visit_id", "site_code", "site_name", "lat", "lng", "sampled_year",
                         "stream_order")
    return counts.join(meta, "site_visit_id", "left").select(
        "site_visit_id",
        F.coalesce("site_code", F.col("site_visit_id").cast("string")).alias("site_code"),
        "site_name", "lat", "lng", F.coalesce("sampled_year", F.lit(0)).alias("sampled_year"),
        "stream_order", "ept_richness", F.round("ept_count", 4).alias("ept_count"),
        F.round("total_count", 4).alias("total_count"), F.round(share, 4).alias("ept_proportion"),
        "total_taxa_richness", habitat_quality(share).alias("habitat_quality"))


def benthic_area(samples: DataFrame) -> DataFrame:
    q = F.col("habitat_quality")
    n = F.count("*")
    summary = samples.agg(
        n.alias("visit_count"), F.round(F.avg("ept_proportion"), 3).alias("mean_ept_proportion"),
        F.round(F.avg("ept_richness"), 1).alias("mean_ept_richness"),
        F.avg("ept_proportion").alias("mean_prop"),
        *[F.count_if(q == k).alias(k) for k in ("high", "moderate", "impaired")])
    sites = samples.select("site_code").distinct().agg(F.count("*")).scalar()
    return summary.withColumn("site_count", sites)


def most_common(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value per group; equal counts go to the smallest value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    if group:
        return first_per_group(counted, group, [F.desc("n"), F.col(value)])
    return counted.orderBy(F.desc("n"), value).limit(1)


def prediction_rollup(predictions: DataFrame) -> DataFrame:
    mean = F.avg("prob")
    out = predictions.groupBy("species").agg(
        F.count("*").alias("n"), F.round(F.max("prob"), 3).alias("max_probability"),
        mean.alias("_m"))
    tier = F.when(F.col("_m") > 0.65, "high").when(F.col("_m") >= 0.4, "moderate").otherwise("low")
    return out.select("species", "n", "max_probability", F.round("_m", 3).alias("mean_probability"),
                      tier.alias("tier"))


def species_totals(frames: list[tuple[str, DataFrame]], minimum: int) -> DataFrame:
    """Records per species over several sources, ignoring case; spelling of the first source."""
    counted = None
    for rank, (_, frame) in enumerate(frames):
        part = frame.groupBy("species").agg(F.count("*").alias("n")).withColumn("src", F.lit(rank))
        counted = part if counted is None else counted.unionByName(part)
    out = counted.groupBy(F.lower("species").alias("species_key")).agg(
        F.min_by("species", F.struct("src", "species")).alias("species"), F.sum("n").alias("n"))
    return out.where(F.col("n") >= minimum)


def with_min_max(df: DataFrame, value: str, name: str, flat: float = 0.5) -> DataFrame:
    """Scale to 0..1 over the whole table; the bounds are scalar subqueries."""
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    scaled = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).when(
        F.col(value).isNotNull(), F.lit(flat))
    return df.withColumn(name, scaled)


def with_log_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """log1p scaled by its maximum, nulls counting as zero."""
    filled = F.log1p(F.coalesce(F.col(value), F.lit(0)).cast("double"))
    top = df.agg(F.max(filled)).scalar()
    raw = F.coalesce(F.col(value), F.lit(0)).cast("double")
    scaled = F.when(top > 0, filled / top).otherwise(
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(name, scaled)


def rank_thresholds(df: DataFrame, columns: list[str], cuts: dict[str, float]) -> DataFrame:
    """Value at position int(n * share) of the descending order, per score column and cut."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("x")) for c in columns
    ])).alias("s")).select("s.score", "s.x")
    n = F.col("n")
    found = values_at(long, ["score"], "x", {
        name: n - 1 - F.least(F.floor(n * share), n - 1) for name, share in cuts.items()})
    return found.select("score", F.col("name").alias("cut"), F.round("v", 5).alias("threshold"))


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """First quartile, median and third quartile with linear interpolation."""
    n = F.col("n")
    spots = {f"{side}{q}": (n - 1) * q / 4 for q in (1, 2, 3) for side in ("f", "c")}
    one = df.select(F.lit(1).alias("g"), F.col(value).cast("double").alias("x"))
    found = values_at(one, ["g"], "x", {
        k: (F.floor(p) if k[0] == "f" else F.ceil(p)) for k, p in spots.items()})
    at = lambda k: F.max(F.when(F.col("name") == k, F.col("v")))
    total = df.agg(F.count(value)).scalar()
    out = []
    for q, name in ((1, "q1"), (2, "median"), (3, "q3")):
        rest = (total - 1) * q / 4 - F.floor((total - 1) * q / 4)
        out.append((at(f"f{q}") + (at(f"c{q}") - at(f"f{q}")) * rest).alias(name))
    return found.agg(*out)


def source_counts(frames: dict[str, DataFrame], species: list[str]) -> DataFrame:
    """Records per species and source; the two bass names count as one."""
    pooled = F.when(F.col("species").isin(BASS_POOL), BASS_POOL[0]).otherwise(F.col("species"))
    out = None
    for name, frame in frames.items():
        part = frame.withColumn("species", pooled).where(F.col("species").isin(species)).groupBy(
            "species").agg(F.count("*").alias("c")).withColumn("src", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("species").agg(*[
        F.coalesce(F.sum(F.when(F.col("src") == s, F.col("c"))), F.lit(0)).alias(f"{s}_count")
        for s in frames])


def longest_per_key(df: DataFrame, key: str, text: str, tie: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.min_by(text, F.struct(-F.length(text), F.col(tie))).alias(text),
        F.max(F.length(text)).cast("bigint").alias("char_count"))
