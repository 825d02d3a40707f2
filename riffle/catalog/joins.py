"""Equality, proximity, containment and as-of joins."""

from pyspark.sql import functions as F

from riffle.catalog.filters import hav
from riffle.catalog.registry import query
from riffle.functions import geo
from riffle.operators import joins as J
from riffle.operators import spatial as S
from riffle.operators import windows as Wn

KM = "sqrt(power((a.lat - b.lat) * 111.0, 2) + power((a.lng - b.lng) * 80.5, 2))"
KMX = "sqrt(power(a.lat * 111.0 - b.lat * 111.0, 2) + power(a.lng * 80.5 - b.lng * 80.5, 2))"
DEG = "sqrt(power(a.lat - b.lat, 2) + power(a.lng - b.lng, 2))"


@query("c2_dimension_enrichment", """
    SELECT record_id, temp_c, s_name AS supplier_name, CASE WHEN turbidity_fnu > 25 THEN 'turbid'
      ELSE 'clear' END AS clarity FROM readings LEFT JOIN supplier ON station_id = s_suppkey""")
def _(t):
    return t.readings.join(t.supplier, F.col("station_id") == F.col("s_suppkey"), "left").select(
        "record_id", "temp_c", F.col("s_name").alias("supplier_name"),
        F.when(F.col("turbidity_fnu") > 25, "turbid").otherwise("clear").alias("clarity"))


@query("c3_aggregate_to_metadata", """
    SELECT x.v AS site_visit_id, coalesce(v.site_code, CAST(x.v AS VARCHAR)) AS site_code,
      coalesce(v.sampled_year, 0) AS sampled_year, total FROM
      (SELECT site_visit_id * 2 AS v, sum(n) AS total FROM taxa GROUP BY 1) x
      LEFT JOIN visits v ON v.site_visit_id = x.v""")
def _(t):
    agg = t.taxa.groupBy((F.col("site_visit_id") * 2).alias("site_visit_id")).agg(
        F.sum("n").alias("total"))
    return agg.join(t.visits, "site_visit_id", "left").select(
        "site_visit_id", F.coalesce("site_code", F.col("site_visit_id").cast("string")).alias(
            "site_code"), F.coalesce("sampled_year", F.lit(0)).alias("sampled_year"), "total")


@query("c4_semi_join", """
    SELECT site_visit_id, family, n FROM taxa WHERE site_visit_id IN
      (SELECT site_visit_id FROM visits WHERE province = 'ON')""")
def _(t):
    return t.taxa.join(t.visits.where("province = 'ON'"), "site_visit_id", "left_semi").select(
        "site_visit_id", "family", "n")


@query("c5_anti_join", """
    SELECT ogf_id, species, prob FROM predictions WHERE ogf_id NOT IN
      (SELECT ogf_id FROM segments WHERE watercourse_type = 'Virtual Flow')""")
def _(t):
    lakes = t.segments.where("watercourse_type = 'Virtual Flow'")
    return t.predictions.join(lakes, "ogf_id", "left_anti").select("ogf_id", "species", "prob")


@query("c6_name_overlap_anti_join", """
    SELECT p_partkey AS item FROM part p WHERE NOT EXISTS (SELECT 1 FROM
      (SELECT DISTINCT lower(p_name) AS v FROM part WHERE p_size > 48) x
      WHERE contains(lower(p.p_name), v) OR contains(v, lower(p.p_name)))""")
def _(t):
    visited = t.part.where("p_size > 48").select(F.col("p_name").alias("v"))
    return J.without_name_overlap(t.part, "p_name", visited, "v").select(
        F.col("p_partkey").alias("item"))


@query("c7_full_outer_merge", """
    WITH a AS (SELECT species, count(*) AS n, min(common_name) AS c FROM observations GROUP BY 1),
         b AS (SELECT species, count(*) AS n, min(common_name) AS c,
           array_to_string(list_sort(list_distinct(list(basis_of_record))), ',') AS k
           FROM gbif GROUP BY 1)
    SELECT coalesce(a.species, b.species) AS species, coalesce(a.n, 0) AS inat_count,
      coalesce(b.n, 0) AS gbif_count, coalesce(k, '') AS basis, coalesce(b.c, a.c) AS common_name
    FROM a FULL OUTER JOIN b ON a.species = b.species""")
def _(t):
    return J.merge_species_sources(t.observations, t.gbif).withColumn(
        "basis", F.array_join("basis", ","))


@query("c8_merge_sources_by_code", """
    SELECT code, CAST(sum(e) AS BIGINT) AS ebird, CAST(sum(i) AS BIGINT) AS inat, max(d) AS latest FROM (
      SELECT station_id % 5 AS code, 1 AS e, 0 AS i, CAST(ts AS DATE) AS d FROM gauges
      UNION ALL SELECT taxon_id % 7, 0, 1, observed_on FROM observations) GROUP BY 1""")
def _(t):
    both = t.gauges.select((F.col("station_id") % 5).alias("code"), F.lit(1).alias("e"),
                           F.lit(0).alias("i"), F.to_date("ts").alias("d")).unionByName(
        t.observations.select((F.col("taxon_id") % 7).alias("code"), F.lit(0).alias("e"),
                              F.lit(1).alias("i"), F.col("observed_on").alias("d")))
    return both.groupBy("code").agg(
        F.sum("e").alias("ebird"), F.sum("i").alias("inat"), F.max("d").alias("latest"))


@query("c9_nearest_unbounded", f"""
    SELECT ogf_id, substrate, round(d, 6) AS km FROM (
      SELECT a.ogf_id, b.substrate_class AS substrate, {KMX} AS d, row_number() OVER
        (PARTITION BY a.ogf_id ORDER BY {KMX}, b.unit_id) AS rn FROM segments a, geology b)
    WHERE rn = 1""")
def _(t):
    return S.with_nearest(t.segments, t.geology, S.KM_SCALED, "unit_id", ["substrate_class"]).select(
        "ogf_id", F.col("near_substrate_class").alias("substrate"),
        F.round("distance", 6).alias("km"))


@query("c10_nearest_bounded", f"""
    SELECT ogf_id, CASE WHEN d <= 5 THEN round(d, 6) END AS km FROM (
      SELECT a.ogf_id, min({KMX}) AS d FROM segments a, observations b GROUP BY 1)""")
def _(t):
    return S.with_nearest(
        t.segments, t.observations, S.KM_SCALED, "observation_id", bound=5.0
    ).select("ogf_id", F.round("distance", 6).alias("km"))


@query("c11_snap_or_drop", f"""
    SELECT observation_id, ogf_id FROM (
      SELECT a.observation_id, b.ogf_id, {DEG} AS d, row_number() OVER
        (PARTITION BY a.observation_id ORDER BY {DEG}, b.ogf_id) AS rn
      FROM observations a JOIN segments b ON b.lat BETWEEN a.lat - 0.09 AND a.lat + 0.09
        AND b.lng BETWEEN a.lng - 0.09 AND a.lng + 0.09) WHERE rn = 1 AND d <= 0.09""")
def _(t):
    return S.with_nearest(
        t.observations, t.segments, S.DEGREES, "ogf_id", bound=0.09, how="inner"
    ).select("observation_id", F.col("near_ogf_id").alias("ogf_id"))


@query("c12_range_count", f"""
    SELECT a.ogf_id, count(b.observation_id) AS n FROM segments a LEFT JOIN observations b
      ON {DEG} <= 0.225 GROUP BY 1""")
def _(t):
    return S.with_radius_count(t.segments, t.observations, 0.225, S.DEGREES).select("ogf_id", "n")


@query("c13_recent_nearest_attribute", f"""
    WITH s AS (SELECT site, lat, lng, min(record_id * 100 + CAST(replace(species, 'Brand#', '') AS
        BIGINT)) AS k FROM stocking WHERE year >= 1999 GROUP BY 1, 2, 3),
      m AS (SELECT a.ogf_id, s.k, row_number() OVER (PARTITION BY a.ogf_id ORDER BY
        sqrt(power(a.lat - s.lat, 2) + power(a.lng - s.lng, 2)), s.k) AS rn FROM segments a JOIN s
        ON sqrt(power(a.lat - s.lat, 2) + power(a.lng - s.lng, 2)) <= 0.05)
    SELECT a.ogf_id, m.k IS NOT NULL AS is_stocked, 'Brand#' || CAST(m.k % 100 AS VARCHAR) AS species
    FROM segments a LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON a.ogf_id = m.ogf_id""")
def _(t):
    recent = t.stocking.where("year >= 1999").withColumn("k", F.col("record_id") * 100 + F.replace(
        F.col("species"), F.lit("Brand#"), F.lit("")).cast("bigint"))
    return S.with_nearest(t.segments, recent, S.DEGREES, "k", ["species"], bound=0.05).select(
        "ogf_id", F.col("near_k").isNotNull().alias("is_stocked"),
        F.col("near_species").alias("species"))


def lines(t):
    return t.segments.select("ogf_id", geo.wkt_vertices("geom_wkt").alias("vertices"))


@query("c14_nearest_polyline", """
    WITH l AS (SELECT ogf_id, CAST(regexp_extract(geom_wkt, '\\((-?[0-9.]+) ', 1) AS DOUBLE) AS x1,
        CAST(regexp_extract(geom_wkt, '\\(-?[0-9.]+ ([0-9.]+),', 1) AS DOUBLE) AS y1,
        CAST(regexp_extract(geom_wkt, ', (-?[0-9.]+) ', 1) AS DOUBLE) AS x2,
        CAST(regexp_extract(geom_wkt, ', -?[0-9.]+ ([0-9.]+)\\)', 1) AS DOUBLE) AS y2 FROM segments),
      d AS (SELECT b.ogf_id AS barrier_id, l.ogf_id, b.lat, b.lng, x1, y1, x2, y2,
        least(greatest(((b.lng - x1) * (x2 - x1) + (b.lat - y1) * (y2 - y1)) /
          nullif(power(x2 - x1, 2) + power(y2 - y1, 2), 0), 0), 1) AS f FROM barriers b, l),
      e AS (SELECT barrier_id, ogf_id, sqrt(power(lng - (x1 + coalesce(f, 0) * (x2 - x1)), 2) +
        power(lat - (y1 + coalesce(f, 0) * (y2 - y1)), 2)) AS dist FROM d)
    SELECT barrier_id, ogf_id, round(dist * 111000, 1) AS distance_m FROM (
      SELECT *, row_number() OVER (PARTITION BY barrier_id ORDER BY dist, ogf_id) AS rn FROM e)
    WHERE rn = 1 AND dist <= 0.002""")
def _(t):
    found = S.nearest_line(t.barriers, lines(t), 0.002, "ogf_id", "vertices", piece_deg=0.1)
    b = t.barriers.select(F.col("ogf_id").alias("barrier_id"), "lat", "lng")
    return b.join(found, (b["lat"] == found["l_lat"]) & (b["lng"] == found["l_lng"])).select(
        "barrier_id", "ogf_id", F.round(F.col("distance") * geo.M_PER_DEGREE, 1).alias("distance_m"))


@query("c15_soft_labels", f"""
    WITH v AS (SELECT observation_id, lat, lng FROM observations WHERE is_obscured),
      p AS (SELECT a.observation_id, b.ogf_id FROM v a JOIN segments b ON {DEG} <= 0.198),
      c AS (SELECT observation_id, count(*) AS n FROM p GROUP BY 1),
      s AS (SELECT ogf_id, 1.0 / n AS w FROM p JOIN c USING (observation_id)
        UNION ALL SELECT ogf_id, 1.0 FROM (SELECT a.observation_id, b.ogf_id, row_number() OVER
          (PARTITION BY a.observation_id ORDER BY {DEG}, b.ogf_id) AS rn FROM v a, segments b
          WHERE a.observation_id NOT IN (SELECT observation_id FROM c)) WHERE rn = 1
        UNION ALL SELECT ogf_id, 1.0 FROM (SELECT a.observation_id, b.ogf_id, row_number() OVER
          (PARTITION BY a.observation_id ORDER BY {DEG}, b.ogf_id) AS rn
          FROM (SELECT * FROM observations WHERE NOT is_obscured) a JOIN segments b
            ON {DEG} <= 0.09) WHERE rn = 1)
    SELECT ogf_id, round(sum(w), 6) AS weight FROM s GROUP BY 1""")
def _(t):
    return J.soft_labels(t.observations, t.segments).select(
        "ogf_id", F.round("weight", 6).alias("weight"))


@query("c16_exists_within_by_type", f"""
    SELECT a.ogf_id, coalesce(max(CASE WHEN b.access_type = 'boat_launch' THEN 0.2E0 END), 0.0E0) AS boat,
      coalesce(max(CASE WHEN b.access_type IN ('park', 'conservation_area', 'public_land')
        THEN 0.1E0 END), 0.0E0) AS park FROM segments a LEFT JOIN access b ON {DEG} <= 8.0 / 111.0
    GROUP BY 1""")
def _(t):
    from riffle.plans.access import bonus_within

    out = bonus_within(t.segments, t.access, 8.0, {
        "boat": (["boat_launch"], 0.2), "park": (["park", "conservation_area", "public_land"], 0.1)})
    return out.select("ogf_id", "boat", "park")


@query("c17_banded_nearest", f"""
    SELECT ogf_id, CASE WHEN km <= 3 THEN 0.2E0 WHEN km <= 6 THEN 0.1E0 WHEN km <= 12 THEN 0.0E0
      WHEN km <= 30 THEN -0.2E0 ELSE 0.0E0 END AS modifier FROM (
      SELECT a.ogf_id, min({DEG}) * 111.0 AS km FROM segments a, access b
      WHERE b.access_type IN ('road', 'parking') GROUP BY 1)""")
def _(t):
    roads = t.access.where(F.col("access_type").isin("road", "parking"))
    near = S.with_nearest(t.segments, roads, S.DEGREES, "osm_id", bound=0.30)
    km = F.col("distance") * 111.0
    return near.select("ogf_id", J.banded(
        km, [(3, 0.2), (6, 0.1), (12, 0.0), (30, -0.2)], 0.0).alias("modifier"))


def octagon(half: float, cut_: float, lat="clat", lng="clng"):
    spots = [(half, cut_), (cut_, half), (-cut_, half), (-half, cut_), (-half, -cut_),
             (-cut_, -half), (cut_, -half), (half, -cut_), (half, cut_)]
    return F.array(*[F.struct((F.col(lng) + dx).alias("lng"), (F.col(lat) + dy).alias("lat"))
                     for dx, dy in spots])


_OCT = ("abs(a.lng - b.clng) < 0.4503 AND abs(a.lat - b.clat) < 0.4503 "
        "AND abs(a.lng - b.clng) + abs(a.lat - b.clat) < 0.6806")


@query("c18_point_in_polygon", f"""
    SELECT a.observation_id, max(b.park_id) AS park_id FROM observations a JOIN parks b ON {_OCT}
    GROUP BY 1""")
def _(t):
    parks = t.parks.withColumn("ring", octagon(0.4503, 0.2303))
    found = S.containing_polygons(t.observations, parks, "ring", F.struct("park_id"))
    o = t.observations
    return o.join(found, (o["lat"] == found["l_lat"]) & (o["lng"] == found["l_lng"])).select(
        "observation_id", F.col("best.park_id").alias("park_id"))


@query("c19_nearest_named_line", f"""
    SELECT ogf_id, printf('%s (%.1fkm)', name, d) AS label FROM (
      SELECT a.ogf_id, b.name, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d, row_number() OVER
        (PARTITION BY a.ogf_id ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.ogf_id) AS rn
      FROM segments a JOIN segments b ON b.name IS NOT NULL
        AND abs(a.lat - b.lat) < 0.1) WHERE rn = 1 AND d <= 10""")
def _(t):
    named = t.segments.where("name IS NOT NULL")
    near = S.with_nearest(t.segments, named, S.HAVERSINE, "ogf_id", ["name"], bound=10.0,
                          how="inner")
    return near.select("ogf_id", J.named_stream_label(F.col("near_name"), F.col("distance")).alias(
        "label"))


@query("c20_nearest_access_with_bearing", f"""
    SELECT ogf_id, CASE access_type WHEN 'parking' THEN 'Parking area' ELSE 'Road' END || ' ' ||
      CASE WHEN d < 1 THEN CAST(floor(d * 1000) AS BIGINT) || 'm' ELSE printf('%.1fkm', d) END || ' '
      || (['north','northeast','east','southeast','south','southwest','west','northwest'])
      [1 + CAST(floor(((degrees(atan2(o2 - o1, a2 - a1)) + 360) % 360 + 22.5) / 45) AS BIGINT) % 8]
      AS label FROM (
      SELECT a.ogf_id, b.access_type, a.lat AS a1, a.lng AS o1, b.lat AS a2, b.lng AS o2,
        {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d, row_number() OVER (PARTITION BY a.ogf_id
          ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.osm_id) AS rn
      FROM segments a JOIN access b ON b.access_type IN ('road', 'parking')
        AND abs(a.lat - b.lat) < 0.1) WHERE rn = 1 AND d <= 8""")
def _(t):
    roads = t.access.where(F.col("access_type").isin("road", "parking"))
    near = S.with_nearest(t.segments, roads, S.HAVERSINE, "osm_id", ["access_type"], bound=8.0,
                          how="inner")
    direction = geo.bearing("lat", "lng", "near_at_lat", "near_at_lng")
    return near.select("ogf_id", J.road_label(
        F.col("near_access_type"), F.col("distance"), direction).alias("label"))


@query("c21_as_of_nearest_time", """
    WITH g AS (SELECT *, epoch_us(ts) AS u FROM gauges)
    SELECT reading_id, level_ref FROM (
      SELECT a.reading_id, b.level_m AS level_ref, row_number() OVER (PARTITION BY a.reading_id
        ORDER BY abs(b.u - (a.u - 10800000000)), b.u, b.reading_id) AS rn
      FROM g a LEFT JOIN g b ON a.station_id = b.station_id AND b.u < a.u) WHERE rn = 1""")
def _(t):
    out = Wn.closest_in_time(t.gauges, "station_id", "ts", "reading_id", 3 * 3600,
                             ["level_m"], "ref_")
    return out.select("reading_id", F.col("ref_level_m").alias("level_ref"))


@query("c22_isolated_pond_with_birds", """
    SELECT osm_id FROM water w WHERE feature_type IN ('pond', 'reservoir') AND NOT EXISTS (
      SELECT 1 FROM segments s WHERE abs(w.lat - s.lat) <= 3000 / 111000.0
        AND abs(w.lng - s.lng) / 1.4 <= 3000 / 111000.0)
      AND EXISTS (SELECT 1 FROM birds b WHERE b.observed_on >= DATE '2024-01-31' - 30
        AND abs(w.lat - b.lat) <= 30000 / 111000.0 AND abs(w.lng - b.lng) / 1.4 <= 30000 / 111000.0)""")
def _(t):
    from riffle.plans.water import dispersal_flags

    out = dispersal_flags(t.water, t.segments, t.birds, asof="2024-01-31", stream_m=3000.0,
                          bird_m=30000.0)
    return out.where("waterfowl_dispersal_flag").select("osm_id")


@query("c23_seen_segments", f"""
    WITH seen AS (SELECT ogf_id FROM dismissed UNION SELECT ogf_id FROM (
        SELECT a.trip_id, b.ogf_id, {KMX} AS d, row_number() OVER (PARTITION BY a.trip_id
          ORDER BY {KMX}, b.ogf_id) AS rn FROM trips a JOIN segments b
          ON abs(a.lat - b.lat) < 0.01 AND abs(a.lng - b.lng) < 0.01) WHERE rn = 1 AND d <= 0.5)
    SELECT s.ogf_id, round(length_m * CASE WHEN seen.ogf_id IS NOT NULL THEN 0.3 ELSE 1 END, 4)
      AS score FROM segments s LEFT JOIN seen ON s.ogf_id = seen.ogf_id""")
def _(t):
    from riffle.plans.scores import seen_penalty, seen_segments

    seen = seen_segments(t.dismissed, t.trips, t.segments)
    return t.segments.join(seen, "ogf_id", "left").select(
        "ogf_id", F.round(F.col("length_m") * seen_penalty("seen"), 4).alias("score"))


@query("c24_species_name_resolution", """
    SELECT species, CASE lower(species) WHEN 'semotilus atromaculatus' THEN 'Creek Chub'
      WHEN 'lepomis gibbosus' THEN 'Pumpkinseed' WHEN 'perca flavescens' THEN 'Yellow Perch'
      WHEN 'ameiurus nebulosus' THEN 'Brown Bullhead' WHEN 'catostomus commersonii'
      THEN 'White Sucker' ELSE species END AS common_name, count(*) AS n
    FROM predictions GROUP BY 1, 2""")
def _(t):
    from riffle.plans.species import common_name

    return t.predictions.groupBy("species").agg(F.count("*").alias("n")).select(
        "species", common_name(F.col("species")).alias("common_name"), "n")


@query("c25_batch_questions", """
    SELECT q.osm_id AS qid, count(o.observation_id) AS n, round(coalesce(sum(o.amount), 0), 2)
      AS amount FROM water q LEFT JOIN observations o ON abs(q.lat - o.lat) <= 25 / 111.0
      AND abs(q.lng - o.lng) <= 25 / 111.0 GROUP BY 1""")
def _(t):
    asked = t.water.select(F.col("osm_id").alias("qid"), "lat", "lng")
    out = S.with_radius_sums(
        asked, t.observations, 25 / geo.KM_PER_DEGREE, S.box_metric(1.0),
        {"n": F.lit(1).cast("bigint"), "amount": F.col("amount")})
    return out.select("qid", "n", F.round("amount", 2).alias("amount"))
