"""Choice per group, ordering, set operations."""

from pyspark.sql import functions as F

from riffle.catalog.filters import hav
from riffle.catalog.registry import query
from riffle.operators import ranking as R
from riffle.operators import spatial as S
from riffle.operators import windows as Wn


@query("e1_latest_per_group", """
    SELECT site_code, site_visit_id, sampled_year, lo, hi FROM (
      SELECT *, row_number() OVER (PARTITION BY site_code ORDER BY sampled_year DESC, site_visit_id)
        AS rn, min(sampled_year) OVER (PARTITION BY site_code) AS lo,
        max(sampled_year) OVER (PARTITION BY site_code) AS hi FROM visits) WHERE rn = 1""")
def _(t):
    latest = R.first_per_group(t.visits, ["site_code"], [F.desc("sampled_year"), F.col("site_visit_id")])
    span = t.visits.groupBy("site_code").agg(
        F.min("sampled_year").alias("lo"), F.max("sampled_year").alias("hi"))
    return latest.join(span, "site_code").select("site_code", "site_visit_id", "sampled_year", "lo", "hi")


@query("e2_top_k_per_group", """
    SELECT DISTINCT waterbody_name, year, k, event_rank FROM (
      SELECT waterbody_name, year, record_id AS k, row_number() OVER (PARTITION BY waterbody_name
        ORDER BY year DESC, record_id) AS event_rank FROM stocking) WHERE event_rank <= 5""")
def _(t):
    from riffle.plans.stocking import latest_events

    return latest_events(t.stocking).select(
        "waterbody_name", "year", F.col("record_id").alias("k"), "event_rank")


@query("e3_top_two", """
    SELECT ogf_id, max(CASE WHEN rn = 1 THEN species END) AS top1,
      max(CASE WHEN rn = 1 THEN prob END) AS top1_score,
      max(CASE WHEN rn = 2 THEN species END) AS top2,
      max(CASE WHEN rn = 2 THEN prob END) AS top2_score FROM (
      SELECT *, row_number() OVER (PARTITION BY ogf_id ORDER BY prob DESC, species) AS rn
      FROM predictions) WHERE rn <= 2 GROUP BY 1""")
def _(t):
    return R.top_two(t.predictions, "ogf_id", "species", "prob")


@query("e4_trailing_mean", """
    SELECT reading_id, round(avg(level_m) OVER w, 9) AS level_mean,
      round(avg(discharge_cms) OVER w, 9) AS discharge_mean FROM gauges
    WINDOW w AS (PARTITION BY station_id ORDER BY epoch_us(ts)
      RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def _(t):
    out = Wn.trailing_means(t.gauges, "station_id", "ts", {
        "level_mean": "level_m", "discharge_mean": "discharge_cms"})
    return out.select("reading_id", F.round("level_mean", 9).alias("level_mean"),
                      F.round("discharge_mean", 9).alias("discharge_mean"))


_REF = """WITH g AS (SELECT *, epoch_us(ts) AS u FROM gauges),
    r AS (SELECT a.reading_id, b.level_m AS rl, b.discharge_cms AS rd, row_number() OVER
        (PARTITION BY a.reading_id ORDER BY abs(b.u - (a.u - 10800000000)), b.u, b.reading_id) AS rn
      FROM g a LEFT JOIN g b ON a.station_id = b.station_id AND b.u < a.u),
    t AS (SELECT g.*, CASE WHEN level_m - rl > 0.05 THEN 'rising' WHEN level_m - rl < -0.05
        THEN 'falling' WHEN rl IS NOT NULL THEN 'stable' END AS level_trend,
      CASE WHEN rd = 0 OR rd IS NULL OR discharge_cms IS NULL THEN NULL
        WHEN (discharge_cms - rd) / abs(rd) * 100 > 2 THEN 'rising'
        WHEN (discharge_cms - rd) / abs(rd) * 100 < -2 THEN 'falling' ELSE 'stable' END
        AS discharge_trend,
      avg(level_m) OVER w AS lm, avg(discharge_cms) OVER w AS dm FROM g
      JOIN (SELECT * FROM r WHERE rn = 1) r USING (reading_id)
      WINDOW w AS (PARTITION BY station_id ORDER BY u
        RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, coalesce(discharge_trend, level_trend) AS trend,
      CASE WHEN discharge_cms IS NOT NULL AND dm > 0 THEN
        CASE WHEN discharge_cms / dm > 1.15 THEN 'elevated' WHEN discharge_cms / dm < 0.85
          THEN 'low' ELSE 'normal' END
        WHEN level_m IS NOT NULL AND lm > 0 THEN CASE WHEN level_m - lm > 0.1 THEN 'elevated'
          WHEN level_m - lm < -0.1 THEN 'low' ELSE 'normal' END ELSE 'normal' END AS cls FROM t)"""


@query("e5_trends", _REF + " SELECT reading_id, level_trend, discharge_trend FROM c")
def _(t):
    from riffle.plans.gauges import labelled

    return labelled(t.gauges).select("reading_id", "level_trend", "discharge_trend")


@query("e6_condition_labels", _REF + """ SELECT condition_note, length(fishing_note) AS note_length,
    count(*) AS n FROM (SELECT CASE WHEN cls <> 'normal' AND trend IS NOT NULL
        THEN cls || ' and ' || trend WHEN trend IN ('rising', 'falling') THEN 'normal and ' || trend
        ELSE 'normal and stable' END AS condition_note,
      CASE WHEN cls = 'elevated' AND trend = 'rising' THEN
        'Rising, elevated water — fish tight to structure, avoid main current, try slower backwater areas. Clarity likely reduced.'
      WHEN cls = 'elevated' AND trend = 'falling' THEN
        'Dropping from elevated — often a productive window as fish become active in cleaner water.'
      WHEN cls = 'elevated' THEN
        'High, stable flow — fish are pushed to edges and structure. Target slack water behind boulders or inside bends.'
      WHEN cls = 'low' AND trend = 'falling' THEN
        'Low and dropping — fish are stressed and concentrated in deeper pools. Pressure carefully.'
      WHEN cls = 'low' THEN
        'Low, stable flow — fish are holding in the deepest available water. Downsize gear and approach slowly.'
      WHEN trend = 'rising' THEN
        'Rising but not yet elevated — fish may be starting to move. Worth monitoring; conditions can change quickly.'
      WHEN trend = 'falling' THEN
        'Dropping from normal — conditions are stabilizing. Fishing is often improving as water clears.'
      ELSE 'Normal stable flow — standard conditions for this system.' END AS fishing_note FROM c)
    GROUP BY 1, 2""")
def _(t):
    from riffle.plans.gauges import labelled

    return labelled(t.gauges).groupBy(
        "condition_note", F.length("fishing_note").cast("bigint").alias("note_length")
    ).agg(F.count("*").alias("n"))


@query("e7_greedy_distance_thinning", f"""
    WITH RECURSIVE o AS (SELECT species, observation_id AS id, lat, lng, row_number() OVER (
        PARTITION BY species ORDER BY amount DESC, observation_id) AS rn FROM observations),
      g(species, rn, kept) AS (
        SELECT DISTINCT species, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lng DOUBLE)[]) FROM o
        UNION ALL
        SELECT g.species, o.rn, CASE WHEN len(list_filter(kept, lambda k: {hav('k.lat', 'k.lng', 'o.lat', 'o.lng')} < 40.0)) = 0
          THEN list_append(kept, {{'id': o.id, 'lat': CAST(o.lat AS DOUBLE), 'lng': CAST(o.lng AS DOUBLE)}}) ELSE kept END
        FROM g JOIN o ON o.species = g.species AND o.rn = g.rn + 1 WHERE len(kept) < 25),
      e AS (SELECT species, arg_max(kept, rn) AS kept FROM g GROUP BY 1)
    SELECT species, kept[i].id AS observation_id, CAST(i AS INTEGER) AS rank
    FROM (SELECT species, kept, unnest(generate_series(1, len(kept))) AS i FROM e)""")
def _(t):
    ranked = t.observations
    return S.thin_by_distance(
        ranked, 25, 40.0, ["species"], [F.desc("amount"), F.col("observation_id")],
        "observation_id").select("species", "observation_id", "rank")


@query("e8_convenience_rank", f"""
    WITH x AS (SELECT osm_id, {hav(44.0, -79.5, 'lat', 'lng')} AS d, coalesce(area_m2, 0) AS a FROM water)
    SELECT osm_id, round(0.6 * d / max(d) OVER () + 0.4 * (1 - a / max(a) OVER ()), 6) AS score FROM x
    ORDER BY 0.6 * d / max(d) OVER () + 0.4 * (1 - a / max(a) OVER ()), osm_id LIMIT 15""")
def _(t):
    from riffle.functions import geo

    d = geo.haversine_km(F.lit(44.0), F.lit(-79.5), "lat", "lng")
    out = R.convenience_rank(t.water.withColumn("d", d), "d", "area_m2", 15, "osm_id")
    return out.select("osm_id", F.round("convenience", 6).alias("score"))


@query("e9_sort_and_cap", """
    SELECT observation_id, amount FROM observations ORDER BY amount DESC, observation_id LIMIT 500""")
def _(t):
    return t.observations.select("observation_id", "amount").orderBy(
        F.desc("amount"), "observation_id").limit(500)


@query("f1_order_and_limit", """
    SELECT * FROM (SELECT 'recent trip' AS what, trip_id AS id, trip_date AS d FROM trips
      ORDER BY trip_date DESC, trip_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'oldest record', gbif_key, observed_on FROM gbif
      WHERE observed_on IS NOT NULL ORDER BY observed_on, gbif_key LIMIT 1)""")
def _(t):
    trips = t.trips.orderBy(F.desc("trip_date"), "trip_id").limit(20).select(
        F.lit("recent trip").alias("what"), F.col("trip_id").alias("id"), F.col("trip_date").alias("d"))
    old = t.gbif.where("observed_on IS NOT NULL").orderBy("observed_on", "gbif_key").limit(1)
    return trips.unionByName(old.select(
        F.lit("oldest record").alias("what"), F.col("gbif_key").alias("id"),
        F.col("observed_on").alias("d")))


@query("f2_severity_order", """
    SELECT species, sara_status, CASE sara_status WHEN 'Endangered' THEN 0 WHEN 'Threatened' THEN 1
      WHEN 'Special Concern' THEN 2 WHEN 'Extirpated' THEN 3 WHEN 'Not at Risk' THEN 4
      WHEN 'No Status' THEN 5 ELSE 99 END AS severity FROM ranges
    ORDER BY severity, species""")
def _(t):
    return t.ranges.select("species", "sara_status", R.severity("sara_status").alias("severity")
                           ).orderBy("severity", "species")


@query("f3_nearest_n", f"""
    SELECT osm_id, access_type, round(d, 6) AS km FROM (SELECT *,
      {hav(44.0, -79.5, 'lat', 'lng')} AS d FROM access) ORDER BY d, osm_id LIMIT 15""")
def _(t):
    from riffle.functions import geo

    d = geo.haversine_km(F.lit(44.0), F.lit(-79.5), "lat", "lng")
    return t.access.withColumn("d", d).orderBy("d", "osm_id").limit(15).select(
        "osm_id", "access_type", F.round("d", 6).alias("km"))


@query("f4_filter_then_limit", """
    SELECT doc_id, lang FROM documents WHERE lang = 'en' AND contains(lower(text), 'heron')
    ORDER BY doc_id LIMIT 30""")
def _(t):
    from riffle.functions.predicates import contains_ci

    return t.documents.where((F.col("lang") == "en") & contains_ci("text", "heron")).select(
        "doc_id", "lang").orderBy("doc_id").limit(30)


@query("g1_union_with_padding", """
    SELECT 'a' AS src, species, count(*) AS n, count(place_guess) AS placed,
      CAST(0 AS BIGINT) AS based FROM observations GROUP BY 1, 2
    UNION ALL SELECT 'b', species, count(*), 0, count(basis_of_record) FROM gbif GROUP BY 1, 2""")
def _(t):
    both = t.observations.select(F.lit("a").alias("src"), "species", "lat", "lng", "place_guess"
                                 ).unionByName(t.gbif.select(
        F.lit("b").alias("src"), "species", "lat", "lng", "basis_of_record"), allowMissingColumns=True)
    return both.groupBy("src", "species").agg(
        F.count("*").alias("n"), F.count("place_guess").alias("placed"),
        F.count("basis_of_record").alias("based"))


@query("g2_distinct_union", """
    SELECT ogf_id FROM dismissed UNION SELECT trip_id FROM trips""")
def _(t):
    return t.dismissed.select("ogf_id").union(t.trips.select("trip_id")).distinct()


@query("g3_difference", """
    SELECT ogf_id FROM segments EXCEPT SELECT ogf_id FROM dismissed""")
def _(t):
    return t.segments.select("ogf_id").subtract(t.dismissed.select("ogf_id"))


@query("g4_set_intersection", """
    SELECT observed_on, CASE WHEN bool_or(species_code IN ('osprey1', 'commer1')) THEN 'high'
      WHEN bool_or(species_code IN ('grbher3', 'belkin1')) THEN 'moderate' ELSE 'low' END AS confidence
    FROM birds GROUP BY 1""")
def _(t):
    from riffle.plans.birds import confidence

    return t.birds.groupBy("observed_on").agg(
        confidence(F.collect_set("species_code")).alias("confidence"))


@query("g5_sorted_key_union", """
    SELECT species FROM observations UNION SELECT species FROM gbif ORDER BY 1""")
def _(t):
    return t.observations.select("species").distinct().join(
        t.gbif.select("species").distinct(), "species", "full_outer").orderBy("species")
