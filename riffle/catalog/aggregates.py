"""Grouped summaries."""

from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.domain import SPECIES
from riffle.operators import aggregates as A

MED = "median({0})"


@query("d1_counts_and_breakdown", """
    SELECT species, string_agg(basis_of_record || ': ' || n, ', ' ORDER BY n DESC, basis_of_record)
      AS breakdown FROM (SELECT species, basis_of_record, count(*) AS n FROM gbif GROUP BY 1, 2)
    GROUP BY 1""")
def _(t):
    return A.counts_as_text(t.gbif, ["species"], "basis_of_record")


@query("d2_mean_habitat", """
    SELECT ogf_id, round(avg(prob), 6) AS habitat_score FROM predictions GROUP BY 1""")
def _(t):
    return t.predictions.groupBy("ogf_id").agg(F.round(F.avg("prob"), 6).alias("habitat_score"))


@query("d3_station_medians", """
    SELECT station_id, min(lat) AS lat, min(lng) AS lng, round(median(do_mgl), 6) AS do_median_mgl,
      round(median(ph), 6) AS ph_median, round(median(conductivity_us_cm), 4)
      AS conductivity_median_us_cm FROM readings GROUP BY 1""")
def _(t):
    m = A.station_medians(t.readings)
    return m.select("station_id", "lat", "lng", F.round("do_median_mgl", 6).alias("do_median_mgl"),
                    F.round("ph_median", 6).alias("ph_median"),
                    F.round("conductivity_median_us_cm", 4).alias("conductivity_median_us_cm"))


def monthly_temperatures(t):
    return t.readings.groupBy("station_id", F.year("sampled_at").alias("year"),
                              F.month("sampled_at").alias("month")).agg(
        F.max("station_name").alias("station_name"), F.max("lat").alias("lat"),
        F.max("lng").alias("lng"), F.avg("temp_c").alias("mean_temp_c"),
        F.max("temp_c").alias("max_temp_c"))


THERMAL_SQL = """
    WITH monthly AS (SELECT station_id, year(sampled_at) AS y, month(sampled_at) AS mo,
        max(station_name) AS station_name, max(lat) AS lat, max(lng) AS lng,
        avg(temp_c) AS mean_temp_c, max(temp_c) AS max_temp_c FROM readings GROUP BY 1, 2, 3)
    SELECT station_id, max(station_name) AS station_name, max(lat) AS lat, max(lng) AS lng,
      round(avg(mean_temp_c), 2) AS summer_mean_c, round(max(max_temp_c), 2) AS summer_max_c,
      CASE WHEN avg(mean_temp_c) < 18 THEN 'coldwater' WHEN avg(mean_temp_c) <= 23
           THEN 'coolwater' ELSE 'warmwater' END AS thermal_regime,
      count(DISTINCT y) AS years_of_data
    FROM monthly WHERE mo IN (7, 8) AND mean_temp_c IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"""


@query("d4_thermal_summary", THERMAL_SQL)
def _(t):
    return A.thermal_summary(monthly_temperatures(t)).drop("species_notes")


def _stat(p, cond="true"):
    return (f"SELECT '{p}' AS parameter, round(min(v), 2) AS min, round(median(v), 2) AS median, "
            f"round(max(v), 2) AS max, count(v) AS n FROM (SELECT {p.replace('summer_', '')} AS v, "
            f"sampled_at FROM readings) WHERE v IS NOT NULL AND {cond}")


@query("d5_parameter_stats", " UNION ALL ".join(
    [_stat(p) for p in A.PARAMETERS] + [_stat("summer_temp_c", "month(sampled_at) IN (6, 7, 8)")]))
def _(t):
    return A.parameter_stats(t.readings)


@query("d6_station_summary", """
    SELECT station_id, min(station_name) AS station_name, min(lat) AS lat, min(lng) AS lng,
      count(*) AS reading_count, min(sampled_at) AS first_date, max(sampled_at) AS last_date
    FROM readings GROUP BY 1""")
def _(t):
    return A.station_summary(t.readings)


_FAM = ", ".join(f"'{f}'" for f in A.EPT_FAMILIES)
_EPT = f"(family IN ({_FAM}) OR (taxon_order IN ('Ephemeroptera','Plecoptera','Trichoptera') AND family = ''))"
_TAXON = "CASE WHEN family <> '' THEN family ELSE taxon_order END"
_COUNTS = f"""SELECT site_visit_id, coalesce(sum(n) FILTER (WHERE {_EPT}), 0) AS ept_count,
      sum(n) AS total_count, count(DISTINCT CASE WHEN {_EPT} THEN {_TAXON} END) AS ept_richness,
      count(DISTINCT {_TAXON}) AS total_taxa_richness
    FROM taxa WHERE n > 0 GROUP BY 1"""


@query("d7_benthic_counts", _COUNTS)
def _(t):
    return A.benthic_counts(t.taxa)


@query("d8_ratio_and_class", f"""
    SELECT site_visit_id, round(ept_count / total_count, 4) AS ept_proportion,
      CASE WHEN ept_count / total_count >= 0.5 THEN 'high' WHEN ept_count / total_count >= 0.25
           THEN 'moderate' ELSE 'impaired' END AS habitat_quality FROM ({_COUNTS})
    WHERE total_count > 0""")
def _(t):
    c = A.benthic_counts(t.taxa).where("total_count > 0")
    share = F.col("ept_count") / F.col("total_count")
    return c.select("site_visit_id", F.round(share, 4).alias("ept_proportion"),
                    A.habitat_quality(share).alias("habitat_quality"))


@query("d9_benthic_area", f"""
    WITH s AS (SELECT b.*, v.site_code, round(ept_count / total_count, 4) AS p,
        CASE WHEN ept_count / total_count >= 0.5 THEN 'high' WHEN ept_count / total_count >= 0.25
             THEN 'moderate' ELSE 'impaired' END AS q
      FROM ({_COUNTS}) b LEFT JOIN visits v ON b.site_visit_id = v.site_visit_id)
    SELECT count(*) AS visit_count, count(DISTINCT site_code) AS site_count,
      round(avg(p), 3) AS mean_ept_proportion, round(avg(ept_richness), 1) AS mean_ept_richness,
      count(*) FILTER (WHERE q = 'high') AS high, count(*) FILTER (WHERE q = 'moderate') AS moderate,
      count(*) FILTER (WHERE q = 'impaired') AS impaired FROM s""")
def _(t):
    return A.benthic_area(A.benthic_samples(t.taxa, t.visits)).drop("mean_prop")


@query("d10_waterbody_rollup", """
    WITH r AS (SELECT waterbody_name, count(*) AS event_count, max(year) AS most_recent_year,
        CAST(sum(quantity) AS BIGINT) AS total_quantity,
        array_to_string(list_sort(list_distinct(list(species))), ', ') AS species_stocked,
        array_to_string(list_sort(list_distinct(list(life_stage) FILTER (WHERE life_stage IS NOT NULL))), ', ')
          AS life_stages,
        coalesce(bool_or(year >= 1999 AND lower(life_stage) = 'catchable'), false) AS is_put_and_take,
        max(year) < 1997 AND coalesce(bool_and(lower(life_stage) = 'fry'), true)
          AS wild_population_likely
      FROM stocking GROUP BY 1)
    SELECT *, count(*) OVER () AS total_found FROM r ORDER BY most_recent_year DESC, waterbody_name
    LIMIT 10""")
def _(t):
    from riffle.plans.stocking import waterbodies

    out = waterbodies(t.stocking, asof_year=2002, limit=10)
    return out.select(
        "waterbody_name", "event_count", "most_recent_year", "total_quantity",
        F.array_join("species_stocked", ", ").alias("species_stocked"),
        F.array_join("life_stages", ", ").alias("life_stages"), "is_put_and_take",
        "wild_population_likely", "total_found")


@query("d11_most_common", """
    SELECT unit_code, substrate_class, n FROM (
      SELECT unit_code, substrate_class, count(*) AS n, row_number() OVER
        (PARTITION BY unit_code ORDER BY count(*) DESC, substrate_class) AS rn
      FROM geology GROUP BY 1, 2) WHERE rn = 1""")
def _(t):
    return A.most_common(t.geology, ["unit_code"], "substrate_class")


@query("d12_prediction_rollup", """
    SELECT species, count(*) AS n, round(max(prob), 3) AS max_probability,
      round(avg(prob), 3) AS mean_probability, CASE WHEN avg(prob) > 0.65 THEN 'high'
        WHEN avg(prob) >= 0.4 THEN 'moderate' ELSE 'low' END AS tier FROM predictions GROUP BY 1""")
def _(t):
    return A.prediction_rollup(t.predictions)


@query("d13_species_over_sources", """
    SELECT lower(species) AS species_key, coalesce(min(species) FILTER (WHERE src = 0),
      min(species)) AS species, count(*) AS n FROM (
      SELECT species, 0 AS src FROM observations UNION ALL SELECT species, 1 FROM gbif
      WHERE coordinate_uncertainty_m IS NULL OR coordinate_uncertainty_m <= 5000)
    GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    from riffle.functions.predicates import at_most

    return A.species_totals(
        [("a", t.observations), ("b", t.gbif.where(at_most("coordinate_uncertainty_m", 5000)))], 5)


@query("d14_min_max_scaling", """
    SELECT ogf_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS scaled FROM
      (SELECT ogf_id, least(greatest(length_m / 2000, 0), 2) AS x FROM segments)""")
def _(t):
    x = t.segments.select("ogf_id", F.least(F.greatest(F.col("length_m") / 2000, F.lit(0.0)),
                                            F.lit(2.0)).alias("x"))
    return A.with_min_max(x, "x", "scaled").select("ogf_id", F.round("scaled", 6).alias("scaled"))


@query("d15_log_scaling", """
    SELECT osm_id, round(ln(1 + coalesce(area_m2, 0)) / max(ln(1 + coalesce(area_m2, 0))) OVER (), 6)
      AS pressure FROM water""")
def _(t):
    return A.with_log_max(t.water, "area_m2", "pressure").select(
        "osm_id", F.round("pressure", 6).alias("pressure"))


CUTS = {"p95": 0.05, "p80": 0.20, "p60": 0.40, "p40": 0.60}


@query("d16_rank_thresholds", " UNION ALL ".join(
    f"""SELECT '{c}' AS score, '{k}' AS cut, round(v, 5) AS threshold FROM (
        SELECT {c} AS v, row_number() OVER (ORDER BY {c} DESC) - 1 AS i, count(*) OVER () AS n
        FROM readings) WHERE i = floor(n * {s})"""
    for c in ("conductivity_us_cm", "temp_c") for k, s in CUTS.items()))
def _(t):
    return A.rank_thresholds(t.readings, ["conductivity_us_cm", "temp_c"], CUTS)


@query("d17_quartiles", """
    SELECT round(quantile_cont(conductivity_us_cm, 0.25), 4) AS q1,
      round(quantile_cont(conductivity_us_cm, 0.5), 4) AS median,
      round(quantile_cont(conductivity_us_cm, 0.75), 4) AS q3 FROM readings""")
def _(t):
    q = A.quartiles(t.readings, "conductivity_us_cm")
    return q.select(*[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("d18_coverage_fraction", """
    SELECT round(avg(CASE WHEN do_mgl IS NOT NULL AND turbidity_fnu IS NOT NULL
      AND station_name <> 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM readings""")
def _(t):
    from riffle.functions.predicates import habitat_known

    ok = habitat_known(["do_mgl", "turbidity_fnu", "station_name"], dict(t.readings.dtypes))
    return t.readings.agg(F.round(F.avg(ok.cast("double")), 6).alias("coverage"))


_BIRD_CODES = {"1-URGENT": "grbher3", "2-HIGH": "osprey1", "3-MEDIUM": "belkin1",
               "4-NOT SPECIFIED": "commer1"}
_BIRD_CASE = "CASE species " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _BIRD_CODES.items()) + " END"


@query("d19_piscivore_summary", f"""
    SELECT species_code, count(*) FILTER (WHERE src = 'e') AS ebird_sightings,
      count(*) FILTER (WHERE src = 'i') AS inat_sightings, count(*) AS total_sightings,
      max(how_many) AS max_count, max(observed_on) AS most_recent FROM (
      SELECT species_code, 'e' AS src, how_many, observed_on FROM birds UNION ALL
      SELECT {_BIRD_CASE} AS species_code, 'i', NULL, observed_on FROM observations)
    WHERE species_code IS NOT NULL GROUP BY 1""")
def _(t):
    from riffle.plans.birds import piscivore_summary

    named = t.observations.withColumn(
        "species_code", A.lookup(_BIRD_CODES, F.col("species")))
    return piscivore_summary(t.birds, named)


@query("d20_source_counts", f"""
    SELECT species, count(*) FILTER (WHERE s = 'inat') AS inat_count,
      count(*) FILTER (WHERE s = 'gbif') AS gbif_count FROM (
      SELECT species, 'inat' AS s FROM observations UNION ALL SELECT species, 'gbif' FROM gbif)
    WHERE species IN ('1-URGENT', '3-MEDIUM', 'HOUSEHOLD') GROUP BY 1""")
def _(t):
    return A.source_counts({"inat": t.observations, "gbif": t.gbif},
                           ["1-URGENT", "3-MEDIUM", "HOUSEHOLD"])


@query("d21_longest_text", """
    SELECT source, text, CAST(length(text) AS BIGINT) AS char_count FROM (
      SELECT source, text, row_number() OVER (PARTITION BY source
        ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(t):
    return A.longest_per_key(t.documents, "source", "text", "doc_id")


@query("d22_counts_and_existence", """
    SELECT 'barriers' AS name, count(*) AS n, count(*) > 0 AS present FROM barriers
    UNION ALL SELECT 'trips', count(*), count(*) > 0 FROM trips
    UNION ALL SELECT 'pages', count(*), count(*) > 0 FROM pages""")
def _(t):
    n = F.count("*")
    parts = [
        f.agg(n.alias("n"), (n > 0).alias("present")).select(F.lit(k).alias("name"), "n", "present")
        for k, f in (("barriers", t.barriers), ("trips", t.trips), ("pages", t.pages))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d23_window_means", """
    SELECT station_id, round(avg(level_m), 6) AS level_mean, round(avg(discharge_cms), 6)
      AS discharge_mean FROM gauges GROUP BY 1""")
def _(t):
    return t.gauges.groupBy("station_id").agg(
        F.round(F.avg("level_m"), 6).alias("level_mean"),
        F.round(F.avg("discharge_cms"), 6).alias("discharge_mean"))


@query("d24_scale_by_group_max", """
    SELECT osm_id, round(coalesce(area_m2, 0) / coalesce(nullif(max(area_m2) OVER
      (PARTITION BY feature_type), 0), 1), 6) AS share FROM water""")
def _(t):
    tops = t.water.groupBy("feature_type").agg(F.max("area_m2").alias("top"))
    # one row for each kind of feature, a fixed list
    return t.water.join(F.broadcast(tops), "feature_type").select("osm_id", F.round(
        F.coalesce("area_m2", F.lit(0.0)) / F.coalesce(F.nullif("top", F.lit(0.0)), F.lit(1.0)), 6
    ).alias("share"))


SPECIES_NAMES = SPECIES
