"""Scores, rule classifications and the composed questions."""

from pyspark.sql import functions as F

from riffle.catalog.aggregates import _BIRD_CASE, _BIRD_CODES, _COUNTS
from riffle.catalog.registry import query
from riffle.operators import aggregates as A
from riffle.operators import spatial as S
from riffle.plans import access as Acc
from riffle.plans import scores as Sc

DEG = "sqrt(power(a.centroid_lat - b.lat, 2) + power(a.centroid_lng - b.lng, 2))"
AT = ("centroid_lat", "centroid_lng")

DENS = f"""dens AS (SELECT a.ogf_id, count(b.observation_id) AS observation_density_25km FROM feats a
      LEFT JOIN observations b ON {DEG} <= 0.225 GROUP BY 1),
    f AS (SELECT feats.*, observation_density_25km FROM feats JOIN dens USING (ogf_id)
      WHERE watercourse_type <> 'Virtual Flow'),
    hab AS (SELECT ogf_id, avg(prob) AS h FROM predictions GROUP BY 1),
    x AS (SELECT f.*, a.access_score, a.is_crown_land,
        ln(1 + observation_density_25km) / max(ln(1 + observation_density_25km)) OVER () AS p,
        CASE WHEN observation_density_25km = 0 AND stream_order >= 3 AND substrate_category IN
          ('coarse', 'mixed') THEN greatest(h, 0.35) ELSE h END AS hs,
        least(1.0 + CASE WHEN is_confluence_segment THEN 0.4 WHEN
          distance_to_nearest_confluence_km < 0.5 THEN 0.2 ELSE 0 END
          + CASE WHEN connected_to_waterbody THEN 0.3 ELSE 0 END, 2.0) AS sb,
        CASE WHEN observation_density_25km = 0 THEN 1.5 WHEN observation_density_25km < 5 THEN 1.25
          ELSE 1.0 END AS rm
      FROM f JOIN hab USING (ogf_id) JOIN scored_access a USING (ogf_id))"""


def features(t):
    f = S.with_radius_count(t.feats, t.observations, 0.225, S.DEGREES, "observation_density_25km",
                            left_at=AT)
    return f


def untapped(t, species=None):
    return Sc.untapped_potential(features(t), t.scored_access, t.predictions, species)


UNTAPPED_SQL = f"""WITH {DENS} SELECT ogf_id, stream_order,
      round(hs, 6) AS habitat_score, round(access_score, 6) AS access_score,
      round(p, 6) AS observation_pressure, round(hs * (1 - p) * sb * rm, 6) AS balanced,
      round(hs * (1 - p) * access_score * sb * rm, 6) AS easy,
      round(hs * (1 - p) * (1 - access_score + 0.1) * sb * rm, 6) AS adventure FROM x"""


@query("k2_untapped_potential", UNTAPPED_SQL)
def _(t):
    u = untapped(t)
    r = lambda c, n: F.round(c, 6).alias(n)
    return u.select(
        "ogf_id", "stream_order", r("habitat_score", "habitat_score"),
        r("access_score", "access_score"), r("observation_pressure", "observation_pressure"),
        r("untapped_score_balanced", "balanced"), r("untapped_score_easy", "easy"),
        r("untapped_score_adventure", "adventure")).orderBy(F.desc("balanced"), "ogf_id")


def polygons(t):
    from riffle.catalog.joins import octagon

    return t.parks.withColumn("ring", octagon(0.4503, 0.2303))


def crown(t):
    from riffle.catalog.joins import octagon

    return t.parks.withColumn("clat", F.col("clat") + 0.2).withColumn("ring", octagon(0.3007, 0.2903))


_IN = lambda a, half, cut, dy: (
    f"abs({a}.lng - b.clng) < {half} AND abs({a}.lat - (b.clat + {dy})) < {half} AND "
    f"abs({a}.lng - b.clng) + abs({a}.lat - (b.clat + {dy})) < {round(half + cut, 4)}")
_NEAR = lambda kinds, km: (
    f"EXISTS (SELECT 1 FROM access b WHERE b.access_type IN ({kinds}) AND "
    f"sqrt(power(a.lat - b.lat, 2) + power(a.lng - b.lng, 2)) <= {km} / 111.0)")


ACCESS_SQL = f"""
    WITH p AS (SELECT a.ogf_id, max(b.park_id) AS park_id FROM segments a JOIN parks b
        ON {_IN('a', 0.4503, 0.2303, 0)} GROUP BY 1),
      m AS (SELECT p.ogf_id, CASE park_type WHEN 'Recreational' THEN 0.3E0 WHEN 'Waterway' THEN 0.2E0
        WHEN 'Natural Environment' THEN 0.1E0 WHEN 'Nature Reserve' THEN -0.3E0 WHEN 'Wilderness'
        THEN -0.4E0 ELSE 0.0E0 END AS pm FROM p JOIN parks USING (park_id)),
      r AS (SELECT a.ogf_id, min(sqrt(power(a.lat - b.lat, 2) + power(a.lng - b.lng, 2))) * 111.0 AS km
        FROM segments a JOIN access b ON b.access_type IN ('road', 'parking') GROUP BY 1),
      c AS (SELECT a.ogf_id, EXISTS (SELECT 1 FROM parks b WHERE {_IN('a', 0.3007, 0.2903, 0.2)})
          AS is_crown_land, {_NEAR("'building'", 0.5)} AS bld, {_NEAR("'fishing_spot'", 0.5)} AS fsh,
          {_NEAR("'park', 'conservation_area', 'public_land'", 0.5)} AS prk,
          {_NEAR("'parking'", 0.5)} AS pkg, {_NEAR("'boat_launch'", 1.0)} AS boat FROM segments a),
      s AS (SELECT c.ogf_id, is_crown_land, least(greatest(1.0 + coalesce(pm, 0)
          + CASE WHEN is_crown_land THEN 0.3 ELSE 0 END + CASE WHEN km <= 0.2 THEN 0.2 WHEN km <= 0.5
            THEN 0.1 WHEN km <= 1 THEN 0 WHEN km <= 30 THEN -0.2 ELSE 0 END
          + CASE WHEN bld THEN 0.1 ELSE 0 END + CASE WHEN fsh THEN 0.3 ELSE 0 END
          + CASE WHEN prk THEN 0.1 ELSE 0 END + CASE WHEN pkg THEN 0.1 ELSE 0 END
          + CASE WHEN boat THEN 0.2 ELSE 0 END, 0), 2) AS raw
        FROM c LEFT JOIN m USING (ogf_id) LEFT JOIN r USING (ogf_id))
    SELECT ogf_id, is_crown_land, round(CAST((raw - min(raw) OVER ()) / (max(raw) OVER () -
      min(raw) OVER ()) AS DOUBLE), 6) AS access_score FROM s"""


@query("k1_access_score", ACCESS_SQL)
def _(t):
    out = Acc.access_scores(t.segments, t.access, polygons(t), crown(t))
    return out.select("ogf_id", "is_crown_land", F.round("access_score", 6).alias("access_score"))


@query("k3_structural_bonus", """
    SELECT ogf_id, CAST(least(1.0 + CASE WHEN is_confluence_segment THEN 0.4 WHEN
      distance_to_nearest_confluence_km < 0.5 THEN 0.2 ELSE 0 END + CASE WHEN connected_to_waterbody
      THEN 0.3 ELSE 0 END, 2.0) AS DOUBLE) AS bonus FROM feats""")
def _(t):
    return t.feats.select("ogf_id", F.round(Sc.structural_bonus(), 6).alias("bonus"))


@query("k4_remoteness", """
    SELECT osm_id, CASE WHEN n = 0 THEN 1.5E0 WHEN n < 5 THEN 1.25E0 ELSE 1.0E0 END AS factor FROM
      (SELECT osm_id, osm_id % 9 AS n FROM water)""")
def _(t):
    return t.water.withColumn("n", F.col("osm_id") % 9).select(
        "osm_id", Sc.remoteness("n").alias("factor"))


@query("k5_sampling_floor", """
    SELECT ogf_id, CASE WHEN ogf_id % 4 = 0 AND stream_order >= 3 AND substrate_category IN
      ('coarse', 'mixed') THEN greatest(h, 0.35) ELSE h END AS habitat_score FROM (
      SELECT f.*, (f.ogf_id % 100) / 100.0E0 AS h FROM feats f)""")
def _(t):
    f = t.feats.withColumns({"habitat_score": (F.col("ogf_id") % 100) / 100.0,
                             "observation_density_25km": F.col("ogf_id") % 4})
    return f.select("ogf_id", Sc.sampling_floor().alias("habitat_score"))




@query("k6_find_untapped_water")
def _(t):
    from riffle.session import cut

    found = cut(Sc.find_untapped_water(untapped(t), t.predictions, 44.0, -79.5, 150.0,
                                       species="Lepomis gibbosus", limit=10,
                                       exclude_likely_culverted=True))
    named = t.segments.select("ogf_id", "name", "lat", "lng")
    out = Sc.enrich(found, named, t.access, t.predictions, species="Lepomis gibbosus")
    return out.select("ogf_id", "rank", F.round("untapped_score", 6).alias("untapped_score"),
                      "nearest_named_stream", "nearest_road_access", "nearest_osm_access",
                      "access_note", "structural_note", "exploration_note")


@query("k7_find_exploration_targets")
def _(t):
    from riffle.session import cut

    seen = Sc.seen_segments(t.dismissed, t.trips, t.segments)
    found = cut(Sc.find_exploration_targets(untapped(t), t.predictions, seen, 44.0, -79.5, 150.0,
                                            mode="adventure", limit=5))
    named = t.segments.select("ogf_id", "name", "lat", "lng")
    near = Sc.nearby_species(found, [t.observations, t.gbif], 15.0)
    out = Sc.enrich(found, named, t.access, t.predictions).join(near, "ogf_id", "left")
    species = F.coalesce("nearby_species", F.array().cast("array<string>"))
    return out.select(
        "ogf_id", "rank", F.round("untapped_score", 6).alias("untapped_score"), "fmz", "seen",
        F.array_join(species, ", ").alias("nearby_species"),
        Sc.connectivity_note(F.col("named_stream_3km"), species).alias("connectivity_note"),
        Sc.habitat_summary().alias("habitat_summary"))


@query("k8_notes", """
    SELECT ogf_id, CASE WHEN is_crown_land THEN 'crown' WHEN access_score < 0.3 THEN 'unverified'
        ELSE 'road' END AS access_kind,
      CASE WHEN is_confluence_segment THEN 'Confluence point — multiple streams meet here. High fish congregation probability.'
        WHEN connected_to_waterbody AND nearest_waterbody_distance_m IS NOT NULL THEN
        'Stream connects to nearby water body within ' || CAST(floor(nearest_waterbody_distance_m) AS BIGINT)
        || 'm — likely pool or pond where fish stack.'
        WHEN distance_to_nearest_confluence_km < 0.5 THEN
        'Within 500m of a stream confluence — fish often hold in this zone.'
        ELSE 'No structural features detected from mapped data — verify on satellite view.' END AS structural_note,
      CASE WHEN t || s || e = '' THEN
        'Habitat features not measured at this location — field verification needed.'
        ELSE array_to_string(list_filter([t, s, e], lambda v: v <> ''), ' · ') || '.' END AS habitat_summary
    FROM (SELECT f.*, a.access_score, a.is_crown_land,
      CASE WHEN thermal_regime <> 'unknown' THEN thermal_regime || ' thermal regime' ELSE '' END AS t,
      CASE WHEN substrate_category <> 'unknown' THEN substrate_category || ' substrate' ELSE '' END AS s,
      CASE WHEN ept_quality <> 'unknown' THEN ept_quality || ' EPT quality' ELSE '' END AS e
      FROM feats f JOIN scored_access a USING (ogf_id))""")
def _(t):
    f = t.feats.join(t.scored_access, "ogf_id")
    note = Sc.access_note()
    kind = F.when(note.startswith("Crown"), "crown").when(note.startswith("Road"), "road").otherwise(
        "unverified")
    return f.select("ogf_id", kind.alias("access_kind"), Sc.structural_note().alias("structural_note"),
                    Sc.habitat_summary().alias("habitat_summary"))


@query("k9_water_quality_assessment", """
    WITH m AS (SELECT station_id, median(do_mgl) AS d, median(ph) AS p, min(do_mgl) AS lo,
        median(temp_c) FILTER (WHERE month(sampled_at) IN (6, 7, 8)) AS s,
        median(conductivity_us_cm) AS c FROM readings GROUP BY 1)
    SELECT station_id, array_to_string(list_filter([
        CASE WHEN lo < 3 THEN printf('DO below 3 mg/L recorded (min %.1f mg/L) — hypoxic conditions; most species implausible at these levels.', lo)
          WHEN d < 5 THEN printf('Median DO %.1f mg/L — coolwater and coldwater species implausible.', d) END,
        CASE WHEN p < 5.5 THEN printf('Median pH %.1f — salmonid stress; acid-sensitive species (trout, many darters) likely absent.', p) END,
        CASE WHEN s > 26 THEN printf('Summer median temperature %.1f °C — thermal stress for most Ontario species; even warmwater species stressed.', s)
          WHEN s > 22 THEN printf('Summer median temperature %.1f °C — coldwater species implausible; warmwater species (bass, pike, carp) plausible.', s) END],
        lambda v: v IS NOT NULL), '|') AS ruling_out,
      (CASE WHEN lo >= 3 AND d >= 5 THEN 1 ELSE 0 END) + (CASE WHEN p BETWEEN 5.5 AND 9 THEN 1 ELSE 0 END)
        + (CASE WHEN s <= 22 THEN 1 ELSE 0 END) + (CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END) AS notes
    FROM m""")
def _(t):
    from riffle.plans.habitat import water_quality_assessment

    return water_quality_assessment(t.readings, ["station_id"]).select(
        "station_id", F.array_join("ruling_out", "|").alias("ruling_out"),
        F.size("notes").alias("notes"))


@query("k10_benthic_assessment", f"""
    WITH s AS (SELECT v.site_code, round(ept_count / total_count, 4) AS p, ept_count / total_count AS share
      FROM ({_COUNTS}) b LEFT JOIN visits v ON b.site_visit_id = v.site_visit_id WHERE total_count > 0),
    m AS (SELECT count(*) AS visit_count, count(DISTINCT site_code) AS site_count, avg(p) AS p,
      count(*) FILTER (WHERE share >= 0.5) / count(*) AS high, count(*) FILTER (WHERE share < 0.25) / count(*) AS bad FROM s)
    SELECT visit_count, site_count, round(p, 3) AS mean_ept_proportion, concat_ws('|', 'Mean EPT proportion ' || printf('%.0f%%', p * 100) ||
        CASE WHEN p >= 0.5 THEN ' — predominantly high-quality benthic habitat. Clean gravel substrate with strong EPT community.'
          WHEN p >= 0.25 THEN ' — moderate benthic habitat quality. EPT community present but pollution-tolerant taxa are significant.'
          ELSE ' — impaired benthic community. Pollution-tolerant taxa (Chironomidae, Oligochaeta) dominant.' END,
        CASE WHEN high >= 0.5 THEN printf('%.0f%%', high * 100) || ' of sampled sites rated ''high'' quality.' END,
        CASE WHEN bad >= 0.5 THEN printf('%.0f%%', bad * 100) || ' of sampled sites rated ''impaired''.' END) AS notes,
      CASE WHEN p >= 0.5 THEN 'Coldwater and clean-water species (brook trout, darters, redhorse) are plausible. Substrate and thermal data would further constrain predictions.'
        WHEN p >= 0.25 THEN 'Coolwater generalist species plausible. Sensitive taxa (brook trout) are marginal.'
        ELSE 'Sensitive species (darters, redhorse, trout) are unlikely. Tolerant warmwater species (carp, bullhead, suckers) most plausible.'
        END AS species_implications FROM m""")
def _(t):
    from riffle.plans.habitat import benthic_assessment

    return benthic_assessment(A.benthic_samples(t.taxa, t.visits)).withColumn(
        "notes", F.array_join("notes", "|"))


@query("k11_piscivore_confidence", """
    SELECT d AS observed_on, CASE WHEN bool_or(species_code IN ('osprey1', 'commer1')) THEN 'high'
      WHEN bool_or(species_code IN ('grbher3', 'belkin1')) THEN 'moderate' ELSE 'low' END AS confidence
    FROM (SELECT observed_on AS d, species_code FROM birds) GROUP BY 1""")
def _(t):
    from riffle.plans.birds import confidence

    return t.birds.groupBy("observed_on").agg(
        confidence(F.collect_set("species_code")).alias("confidence"))


@query("k12_stocking_classification", """
    SELECT waterbody_name, is_put_and_take, wild_population_likely, CASE WHEN is_put_and_take
      THEN 'put-and-take' WHEN wild_population_likely THEN 'wild' WHEN last_year > 1999 THEN 'recent'
      ELSE 'old' END AS kind FROM (
      SELECT waterbody_name || species AS waterbody_name, max(year) AS last_year,
        coalesce(bool_or(year >= 2001 AND lower(life_stage) = 'catchable'), false) AS is_put_and_take,
        max(year) < 1999 AND coalesce(bool_and(lower(life_stage) = 'fry'), true)
          AS wild_population_likely FROM stocking GROUP BY 1)""")
def _(t):
    from riffle.plans.stocking import note, waterbodies

    rows = t.stocking.withColumn(
        "waterbody_name", F.concat("waterbody_name", "species"))
    text = note(2004)
    kind = (F.when(text.contains("put-and-take fishery"), "put-and-take")
            .when(text.contains("self-sustaining wild population"), "wild")
            .when(text.contains("too recent"), "recent").otherwise("old"))
    return waterbodies(rows, 2004).select(
        "waterbody_name", "is_put_and_take", "wild_population_likely", kind.alias("kind"))


@query("k13_tactical_rules", """
    WITH g AS (SELECT *, CASE WHEN contains(species, 'darter') THEN 'microfishing'
        WHEN contains(species, 'trout') THEN 'trout' WHEN contains(species, 'bass') THEN 'bass'
        WHEN contains(species, 'pike') THEN 'pike' WHEN contains(species, 'walleye') THEN 'walleye'
        WHEN contains(species, 'catfish') THEN 'catfish' WHEN contains(species, 'bluegill') THEN 'panfish'
        WHEN contains(species, 'carp') THEN 'carp' ELSE 'unknown' END AS grp,
        CASE WHEN month <= 2 THEN 'winter' WHEN month <= 4 THEN 'pre_spawn' WHEN month <= 6 THEN 'spawn'
        WHEN month <= 8 THEN 'summer' WHEN month <= 10 THEN 'fall' ELSE 'early_winter' END AS season,
        (temp_c IS NOT NULL)::INT + (clarity IS NOT NULL)::INT + (pressure IS NOT NULL)::INT
          + (time_of_day IS NOT NULL)::INT AS n FROM moments),
      lim(grp, c, l, h, w) AS (VALUES ('trout', 2, 8, 16, 20), ('bass', 10, 18, 26, 30),
        ('pike', 4, 15, 22, 26), ('walleye', 4, 15, 21, 27), ('catfish', 15, 22, 28, 32),
        ('panfish', 5, 18, 24, 28), ('carp', 8, 16, 24, 30), ('unknown', 10, 18, 26, 30)),
      a AS (SELECT g.*, CASE WHEN temp_c < c THEN 'lethargic' WHEN temp_c < l THEN 'sub_optimal'
        WHEN temp_c <= h THEN 'active' WHEN temp_c <= w THEN 'warm_stress' WHEN temp_c IS NOT NULL
        THEN 'over_warm' END AS act FROM g LEFT JOIN lim USING (grp)),
      s AS (SELECT *, greatest(0, least(2, CASE WHEN act = 'active' OR act IS NULL THEN 1 ELSE 0 END
        + CASE pressure WHEN 'falling' THEN 1 WHEN 'rising' THEN -1 ELSE 0 END)) AS sp,
        CASE WHEN n >= 3 AND grp <> 'unknown' THEN 2 WHEN n >= 2 OR grp <> 'unknown' THEN 1 ELSE 0 END
        AS conf FROM a)
    SELECT moment_id, grp AS "group", season, choice,
      CASE WHEN grp = 'microfishing' THEN 'slow' ELSE ['slow', 'medium', 'fast'][sp + 1] END AS retrieve_speed,
      ['low', 'medium', 'high'][1 + CASE WHEN choice = 1 THEN conf ELSE greatest(conf - 1, 0) END] AS confidence,
      CASE WHEN grp = 'microfishing' THEN '0-2 ft' ELSE coalesce(CASE time_of_day WHEN 'dawn' THEN '0-3 ft'
        WHEN 'morning' THEN '2-10 ft' WHEN 'midday' THEN '10-20 ft' WHEN 'afternoon' THEN '8-18 ft'
        WHEN 'evening' THEN '2-10 ft' WHEN 'dusk' THEN '0-4 ft' WHEN 'night' THEN '0-8 ft' END,
        CASE season WHEN 'winter' THEN '10-25 ft' WHEN 'pre_spawn' THEN '2-10 ft' WHEN 'spawn' THEN '1-6 ft'
        WHEN 'summer' THEN '8-20 ft' WHEN 'fall' THEN '3-15 ft' ELSE '10-25 ft' END) END AS target_depth_range,
      grp IN ('bass', 'pike') AND time_of_day IN ('dawn', 'dusk') AND act IN ('active', 'warm_stress')
        AND season IN ('summer', 'fall', 'pre_spawn') IS TRUE AS topwater
    FROM s JOIN (SELECT unnest([1, 2]) AS choice) ch ON choice = 1 OR grp <> 'microfishing'""".replace(
    "grp IN ('bass', 'pike') AND", "coalesce(grp IN ('bass', 'pike') AND").replace(
    "'pre_spawn') IS TRUE AS topwater", "'pre_spawn'), false) AS topwater"))
def _(t):
    from riffle.plans.tactical import TOPWATER, recommend

    out = recommend(t.moments)
    return out.select(
        "moment_id", "group", "season", "choice", "retrieve_speed", "confidence",
        "target_depth_range", F.col("lure_type").isin(*TOPWATER).alias("topwater"))


@query("k14_at_risk_species", """
    SELECT species, severity, is_protected, CAST(row_number() OVER (ORDER BY severity, species) AS BIGINT)
      AS place FROM (SELECT species, CASE coalesce(sara_status, ontario_status, 'No Status')
        WHEN 'Endangered' THEN 0 WHEN 'Threatened' THEN 1 WHEN 'Special Concern' THEN 2
        WHEN 'Extirpated' THEN 3 WHEN 'Not at Risk' THEN 4 ELSE 5 END AS severity,
      coalesce(sara_status IN ('Threatened', 'Endangered'), false)
        OR coalesce(ontario_status IN ('Threatened', 'Endangered'), false) AS is_protected FROM ranges
      WHERE (sara_status IN ('Threatened', 'Endangered', 'Special Concern', 'Extirpated')
        OR ontario_status IN ('Threatened', 'Endangered', 'Special Concern', 'Extirpated'))
        AND contains(jurisdiction, 'CA-ON'))""")
def _(t):
    from riffle.operators.tables import row_numbers
    from riffle.plans.species import at_risk

    ranges = t.ranges.withColumn("jurisdictions_present", F.array("jurisdiction"))
    out = at_risk(ranges).select("species", "severity", "is_protected")
    return row_numbers(out, ["severity", "species"], "place")


@query("k15_substrate_at_point", """
    SELECT unit_id, substrate_class, (SELECT count(*) FROM geology WHERE lat BETWEEN 44 - 60/111.0
        AND 44 + 60/111.0 AND lng BETWEEN -79.5 - 60/111.0 AND -79.5 + 60/111.0) AS units_nearby,
      (SELECT substrate_class FROM geology WHERE lat BETWEEN 44 - 60/111.0 AND 44 + 60/111.0
        AND lng BETWEEN -79.5 - 60/111.0 AND -79.5 + 60/111.0 GROUP BY 1
        ORDER BY count(*) DESC, substrate_class LIMIT 1) AS dominant_class
    FROM geology WHERE abs(lat - 44) <= 1 AND abs(lng + 79.5) <= 1
    ORDER BY sqrt(power(lat - 44, 2) + power(lng + 79.5, 2)), unit_id LIMIT 1""")
def _(t):
    from riffle.plans.habitat import substrate_at

    return substrate_at(t.geology, 44.0, -79.5, 60.0)


@query("k16_dispersal_flag", """
    SELECT osm_id, feature_type IN ('pond', 'reservoir') AND NOT EXISTS (SELECT 1 FROM segments s WHERE
        abs(w.lat - s.lat) <= 2000 / 111000.0 AND abs(w.lng - s.lng) / 1.4 <= 2000 / 111000.0)
      AND EXISTS (SELECT 1 FROM birds b WHERE b.observed_on >= DATE '2024-02-10' - 30
        AND abs(w.lat - b.lat) <= 20000 / 111000.0 AND abs(w.lng - b.lng) / 1.4 <= 20000 / 111000.0)
      AS waterfowl_dispersal_flag FROM water w""")
def _(t):
    from riffle.plans.water import dispersal_flags

    return dispersal_flags(t.water, t.segments, t.birds, "2024-02-10", 30, 2000.0, 20000.0).select(
        "osm_id", "waterfowl_dispersal_flag")


@query("k17_confidence_tier", """
    SELECT station_id, CASE WHEN count(*) >= 600 THEN 'high' WHEN count(*) >= 590 THEN 'medium'
      ELSE 'low' END AS tier FROM (SELECT station_id FROM readings) GROUP BY 1""".replace(
    "count(*) >= 600", "count(*) / 12 >= 50").replace("count(*) >= 590", "count(*) / 12 >= 15"))
def _(t):
    from riffle.plans.habitat import confidence_tier

    return t.readings.groupBy("station_id").agg(
        confidence_tier(F.count("*") / 12).alias("tier"))


@query("k18_display_tier", """
    WITH r AS (SELECT temp_c AS v, row_number() OVER (ORDER BY temp_c DESC) - 1 AS i, count(*) OVER ()
        AS n FROM readings), c AS (SELECT round(max(v) FILTER (WHERE i = floor(n * 0.05)), 5) AS p95,
        round(max(v) FILTER (WHERE i = floor(n * 0.2)), 5) AS p80,
        round(max(v) FILTER (WHERE i = floor(n * 0.4)), 5) AS p60,
        round(max(v) FILTER (WHERE i = floor(n * 0.6)), 5) AS p40 FROM r)
    SELECT CASE WHEN temp_c >= p95 THEN 1 WHEN temp_c >= p80 THEN 2 WHEN temp_c >= p60 THEN 3
      WHEN temp_c >= p40 THEN 4 ELSE 5 END AS tier, count(*) AS n FROM readings JOIN c ON true GROUP BY 1""")
def _(t):
    from riffle.plans.export import CUTS, tier

    cuts = A.rank_thresholds(t.readings, ["temp_c"], CUTS)
    value = {k: cuts.where(F.col("cut") == k).select("threshold").scalar() for k in CUTS}
    return t.readings.groupBy(tier(F.col("temp_c"), *value.values()).alias("tier")).agg(
        F.count("*").alias("n"))


@query("k19_piscivore_note", f"""
    SELECT count(*) FILTER (WHERE species_code = 'osprey1') AS osprey1,
      count(*) FILTER (WHERE species_code = 'commer1') AS commer1,
      count(*) FILTER (WHERE species_code = 'grbher3') AS grbher3,
      count(*) FILTER (WHERE species_code = 'belkin1') AS belkin1,
      count(*) FILTER (WHERE species_code = 'doccor') AS doccor,
      date_diff('day', greatest(max(observed_on), (SELECT max(observed_on) FROM observations WHERE {_BIRD_CASE} IS NOT NULL)),
        DATE '2024-03-01') AS days_ago FROM birds""")
def _(t):
    from riffle.plans.birds import habitat_note, piscivore_summary

    other = t.observations.withColumn("species_code", A.lookup(_BIRD_CODES, F.col("species")))
    return habitat_note(piscivore_summary(t.birds, other), "2024-03-01").drop("habitat_note")


@query("k20_thermal_notes", """
    SELECT regime, count(*) AS n, max(CASE regime WHEN 'coldwater' THEN 'Summer temps support brook trout, lake trout, and other salmonids. Darters and sensitive cyprinids plausible.'
      WHEN 'coolwater' THEN 'Suitable for walleye, pike, bass. Marginal for salmonids — check for cold groundwater refugia.'
      WHEN 'warmwater' THEN 'Carp, catfish, bass, sunfish. Too warm for sustained salmonid presence.'
      ELSE 'Insufficient temperature data to classify thermal regime.' END) AS note
    FROM (SELECT CASE WHEN temp_c < 18 THEN 'coldwater' WHEN temp_c <= 23 THEN 'coolwater'
      ELSE 'warmwater' END AS regime FROM readings UNION ALL SELECT thermal_regime FROM feats) GROUP BY 1""")
def _(t):
    regimes = t.readings.select(A.thermal_regime("temp_c").alias("regime")).unionByName(
        t.feats.select(F.col("thermal_regime").alias("regime")))
    return regimes.groupBy("regime").agg(F.count("*").alias("n")).withColumn(
        "note", A.lookup(A.THERMAL_NOTES, F.col("regime"), A.THERMAL_NOTES["unknown"]))


@query("c1_wide_assembly", f"""
    SELECT s.ogf_id, s.length_m, coalesce(g.sub, 'unknown') AS substrate_category,
      coalesce(b.n, 0) AS barrier_count, p.prob, coalesce(d.ogf_id IS NOT NULL, false) AS dismissed,
      coalesce(w.m <= 200, false) AS connected FROM segments s
    LEFT JOIN (SELECT unit_id AS ogf_id, substrate_class AS sub FROM geology) g USING (ogf_id)
    LEFT JOIN (SELECT nearest_segment_ogf_id AS ogf_id, count(*) AS n FROM barriers GROUP BY 1) b USING (ogf_id)
    LEFT JOIN (SELECT ogf_id, max(prob) AS prob FROM predictions GROUP BY 1) p USING (ogf_id)
    LEFT JOIN (SELECT DISTINCT ogf_id FROM dismissed) d USING (ogf_id)
    LEFT JOIN (SELECT ogf_id, nearest_waterbody_distance_m AS m FROM feats) w USING (ogf_id)""")
def _(t):
    from riffle.plans.features import assemble

    maps = [
        t.geology.select(F.col("unit_id").alias("ogf_id"), F.col("substrate_class").alias("sub")),
        t.barriers.groupBy(F.col("nearest_segment_ogf_id").alias("ogf_id")).agg(
            F.count("*").alias("barrier_count_upstream")),
        t.predictions.groupBy("ogf_id").agg(F.max("prob").alias("prob")),
        t.dismissed.select("ogf_id").distinct().withColumn("gone", F.lit(True)),
        t.feats.select("ogf_id", "nearest_waterbody_distance_m"),
    ]
    out = assemble(t.segments.select("ogf_id", "length_m"), maps)
    return out.select(
        "ogf_id", "length_m", F.coalesce("sub", F.lit("unknown")).alias("substrate_category"),
        F.col("barrier_count_upstream").alias("barrier_count"), "prob",
        F.coalesce("gone", F.lit(False)).alias("dismissed"),
        F.coalesce(F.col("nearest_waterbody_distance_m") <= 200, F.lit(False)).alias("connected"))


