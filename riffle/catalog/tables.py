"""Sources, sinks and table maintenance over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.functions import predicates as P
from riffle.operators import tables as Tb
from riffle.plans.keyed_store import KeyedStore
from riffle.session import checkpoint_dir
from riffle.sources import delimited as D
from riffle.sources import json_documents as Js
from riffle.sources import kml as K
from riffle.sources import osm as O
from riffle.sources import polygons as Pg


ARRAY_ROWS = 10_000


def folder(t, name):
    return f"{checkpoint_dir(t.spark)}/landed-{name}-{uuid.uuid4().hex}"


def landed(t, name, df, fmt="json", by=(), **options):
    path = folder(t, name)
    df.write.options(**options).format(fmt).partitionBy(*by).save(path)
    return path


@query("a1_projected_scan", "SELECT ogf_id, lat, lng FROM segments WHERE lat > 45.5")
def _(t):
    from riffle.domain import lat, lng

    part = t.part.select("p_partkey")
    return part.selectExpr("p_partkey AS ogf_id", f"{lat('p_partkey', 11)} AS lat",
                           f"{lng('p_partkey', 11)} AS lng").where("lat > 45.5")


@query("a2_parquet_rewrite", "SELECT ogf_id, species, prob FROM predictions")
def _(t):
    path = folder(t, "predictions")
    for _ in range(2):
        t.predictions.select("ogf_id", "species", "prob").write.mode("overwrite").parquet(path)
    return t.spark.read.schema("ogf_id bigint, species string, prob double").parquet(path)


@query("a3_stocking_csv", """
    SELECT CAST(record_id AS VARCHAR) AS record_id, waterbody_name, array_to_string(list_transform(
        string_split(lower(species), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS species,
      CAST(year AS INTEGER) AS year, quantity, life_stage, make_date(CAST(year AS BIGINT), 1, 1) AS stocked_at
    FROM (SELECT l_orderkey * 10 + l_linenumber AS record_id, CASE WHEN l_linenumber = 1 THEN p_name
        WHEN l_linenumber < 6 THEN p_brand END AS waterbody_name, p_type || ' fish' AS species,
        year(l_shipdate) AS year, CAST(l_quantity AS BIGINT) AS quantity, CASE l_returnflag WHEN 'A'
        THEN 'Catchable' WHEN 'N' THEN 'Fry' END AS life_stage FROM lineitem JOIN part ON l_partkey = p_partkey)
    WHERE waterbody_name IS NOT NULL""")
def _(t):
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    raw = l.select(
        (F.col("l_orderkey") * 10 + n).cast("string").alias("ObjectId"),
        F.when(n == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("Official_Waterbody_Name"),
        F.when(n.between(2, 5), F.col("p_brand")).alias("Unoffcial_Waterbody_Name"),
        F.upper(F.concat("p_type", F.lit(" FISH"))).alias(" Species "),
        F.year("l_shipdate").cast("string").alias("Stocking_Year"),
        F.col("l_quantity").cast("bigint").cast("string").alias("Number_of_Fish_Stocked"),
        F.when(F.col("l_returnflag") == "A", "Catchable").when(
            F.col("l_returnflag") == "N", "Fry").alias("Developmental_Stage"),
        F.lit("").alias("Latitude"), F.lit("").alias("Longitude"))
    path = landed(t, "stocking", raw, "csv", header=True, ignoreLeadingWhiteSpace=False,
                  ignoreTrailingWhiteSpace=False)
    good, _bad = D.stocking(D.read_text_columns(t.spark, path))
    return good.select("record_id", "waterbody_name", "species", "year", "quantity", "life_stage",
                       "stocked_at")


def field_files(t):
    l = t.lineitem
    n = F.col("l_linenumber")
    day = F.date_format("l_shipdate", "MM/dd/yyyy")
    vals = [F.when(n != 3, F.col("l_tax")).cast("string"), F.when(n != 3, F.col("l_discount")).cast("string")]
    new = l.where(n <= 3).select(
        F.year("l_shipdate").alias("YEAR"), F.col("l_orderkey").alias("Field_ID"),
        F.format_string("%010d", "l_suppkey").alias("Collection_Site"), day.alias("Collection_Date"),
        vals[0].alias("Dissolved_Oxygen_mgl"), vals[1].alias("Field_PH"))
    old = l.where(n > 3).select(
        F.year("l_shipdate").alias("Year"), F.col("l_orderkey").alias("Lab Workorder ID"),
        n.alias("Lab Sample ID"), F.format_string("%010d", "l_suppkey").alias("Collection Site"),
        day.alias("Collection Date"), F.col("l_tax").cast("string").alias("Dissolved Oxygen mgl"),
        F.col("l_discount").cast("string").alias("Field PH"))
    return [D.read_text_columns(t.spark, landed(t, f"field{i}", x, "csv", header=True), D.underscored)
            for i, x in enumerate((new, old))]


def station_rows(t):
    raw = t.supplier.select(F.format_string("%011d", "s_suppkey").alias("STATION"),
                            F.concat(F.lit("Creek, at "), "s_name").alias("NAME"),
                            F.col("s_acctbal").cast("string").alias("LATITUDE"),
                            F.lit(" ").alias("LONGITUDE"))
    return D.stations(D.read_text_columns(t.spark, landed(t, "stations", raw, "csv", header=True)))


@query("a4_three_header_variants", """
    SELECT CASE WHEN l_linenumber <= 3 THEN year(l_shipdate) || '_' || l_orderkey ELSE year(l_shipdate)
        || '_' || l_orderkey || '_' || l_linenumber END AS record_id, lpad(CAST(l_suppkey AS VARCHAR), 11, '0')
      AS station_id, CAST(l_shipdate AS DATE) AS sampled_at, l_tax AS do_mgl, l_discount AS ph,
      'Creek, at ' || s_name AS station_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_linenumber <> 3""")
def _(t):
    good, _bad = D.field_data(D.union_variants(field_files(t)), station_rows(t))
    return good.select("record_id", "station_id", "sampled_at", "do_mgl", "ph", "station_name")


@query("a5_station_dimension", """
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS station_id, 'Creek, at ' || s_name AS station_name,
      s_acctbal AS lat, CAST(NULL AS DOUBLE) AS lng FROM supplier""")
def _(t):
    return station_rows(t)


def study_file(t):
    raw = t.visits.select(
        F.col("site_visit_id").alias("SiteVisitID/IdentifiantdeVisite"),
        F.col("province").alias("Province/Province"), F.when(
            F.col("site_visit_id") % 3 != 0, F.col("site_code")).alias("Site/Site"),
        F.col("site_name").alias("SiteName/NomduSite"), F.col("lat").alias("Latitude"),
        F.col("lng").alias("Longitude"), F.when(F.col("site_visit_id") % 7 != 0, F.col(
            "sampled_year")).cast("string").alias("Year/Année"),
        F.lit("").alias("JulianDay/JourJulien"), F.col("stream_order").alias("StreamOrder/Ordre"),
        F.lit(" ").alias("LocalBasinName/Bassin"))
    path = landed(t, "study", raw, "csv", header=True, encoding="UTF-16")
    enc = D.encoding_of(t.spark, path + "/*.csv")
    return D.read_text_columns(t.spark, path, D.bilingual, enc)


@query("a6_bilingual_utf16", """
    SELECT CAST(site_visit_id AS VARCHAR) AS "SiteVisitID", province AS "Province" FROM visits""")
def _(t):
    return study_file(t).select("SiteVisitID", "Province")


@query("a35_visit_dimension", """
    SELECT CAST(site_visit_id AS VARCHAR) AS site_visit_id, CASE WHEN site_visit_id % 3 <> 0 THEN site_code
      ELSE CAST(site_visit_id AS VARCHAR) END AS site_code, CAST(sampled_year AS INTEGER) AS sampled_year,
      province = 'ON' AS in_province FROM visits WHERE site_visit_id % 7 <> 0""")
def _(t):
    dim, ids = D.study(study_file(t))
    return dim.join(ids.withColumn("on", F.lit(True)), "site_visit_id", "left").select(
        "site_visit_id", "site_code", "sampled_year", F.coalesce("on", F.lit(False)).alias("in_province"))


@query("a7_observation_documents", """
    SELECT observation_id, species, lat, lng, observed_on, geoprivacy, is_obscured,
      CASE WHEN is_obscured THEN 22.0E0 END AS obscuration_radius_km FROM observations
    WHERE place_guess IS NOT NULL""")
def _(t):
    o = t.observations
    doc = F.struct(
        F.col("observation_id").alias("id"), F.struct(F.col("species").alias("name")).alias("taxon"),
        F.when(F.col("place_guess").isNotNull(), F.concat_ws(",", "lat", "lng")).alias("location"),
        F.col("observed_on").cast("string").alias("observed_on"),
        F.when(F.col("is_obscured"), "obscured").alias("geoprivacy"), "place_guess")
    docs = o.groupBy(F.floor(F.col("observation_id") / 200).alias("b")).agg(F.collect_list(doc).alias("results"))
    path = landed(t, "observations", docs.select("results"))
    return Js.observations(Js.read(t.spark, path, Js.OBSERVATIONS)).select(
        "observation_id", "species", "lat", "lng", "observed_on", "geoprivacy", "is_obscured",
        "obscuration_radius_km")


@query("a8_occurrence_documents", """
    SELECT gbif_key, species, lat, lng, observed_on, basis_of_record, coordinate_uncertainty_m FROM gbif""")
def _(t):
    doc = F.struct(
        F.col("gbif_key").alias("key"), F.col("species").alias("scientificName"),
        F.col("lat").alias("decimalLatitude"), F.col("lng").alias("decimalLongitude"),
        F.concat(F.col("observed_on").cast("string"), F.lit("T10:00:00")).alias("eventDate"),
        F.col("basis_of_record").alias("basisOfRecord"),
        F.col("coordinate_uncertainty_m").alias("coordinateUncertaintyInMeters"))
    docs = t.gbif.groupBy(F.floor(F.col("gbif_key") / 200).alias("b")).agg(F.collect_list(doc).alias("results"))
    path = landed(t, "occurrences", docs.select("results"))
    return Js.occurrences(Js.read(t.spark, path, Js.OCCURRENCES)).select(
        "gbif_key", "species", "lat", "lng", "observed_on", "basis_of_record", "coordinate_uncertainty_m")


def features(t, name, rows, key):
    # a response document holds at most 200 features
    docs = rows.groupBy(F.floor(F.col(key) / 200).alias("b")).agg(F.collect_list("feature").alias("features"))
    return landed(t, name, docs.select("features"))


@query("a9_station_features", """
    SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name, s_acctbal AS lat
    FROM supplier WHERE s_nationkey % 3 <> 0""")
def _(t):
    f = F.struct(
        F.struct(F.array(F.lit(-80.0), F.col("s_acctbal")).alias("coordinates")).alias("geometry"),
        F.struct(F.col("s_suppkey").cast("string").alias("STATION_NUMBER"), F.col("s_name").alias(
            "STATION_NAME"), F.when(F.col("s_nationkey") % 3 == 0, "Inactive").otherwise("Active").alias(
            "STATUS_EN")).alias("properties")).alias("feature")
    path = features(t, "stations", t.supplier.select("s_suppkey", f), "s_suppkey")
    return Js.gauge_stations(Js.read(t.spark, path, Js.STATIONS)).select(
        "station_id", "station_name", "lat")


@query("a10_reading_features", """
    SELECT CAST(station_id AS VARCHAR) AS station_id, date_trunc('second', ts) AS ts, level_m,
      discharge_cms FROM gauges""")
def _(t):
    when = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    even = F.col("reading_id") % 2 == 0
    f = F.struct(F.struct(
        F.col("station_id").cast("string").alias("STATION_NUMBER"),
        F.when(even, when).alias("DATETIME"), F.when(~even, when).alias("DATE_TIME"),
        F.col("level_m").cast("string").alias("LEVEL"), F.coalesce(F.col("discharge_cms").cast(
            "string"), F.lit("n/a")).alias("DISCHARGE")).alias("properties")).alias("feature")
    path = features(t, "readings", t.gauges.select("reading_id", f), "reading_id")
    return Js.gauge_readings(Js.read(t.spark, path, Js.READINGS)).select(
        "station_id", F.col("reading_datetime").cast("timestamp_ntz").alias("ts"),
        F.col("water_level_m").alias("level_m"), "discharge_cms")


def osm_file(t):
    k = F.col("c_custkey")
    tags = F.map_filter(F.create_map(
        F.lit("natural"), F.when(k % 3 == 0, "water"), F.lit("water"), F.when(k % 6 == 0, "pond"),
        F.lit("leisure"), F.when(k % 3 == 1, "fishing"), F.lit("highway"), F.when(k % 3 == 2, "primary"),
        F.lit("name"), F.when(k % 4 == 0, F.col("c_name"))), lambda _, v: v.isNotNull())
    corner = lambda dy, dx: F.struct((F.lit(44.0) + dy).alias("lat"), (F.lit(-80.0) + dx).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.0, 0.01), corner(0.01, 0.01), corner(0.01, 0.0), corner(0.0, 0.0))
    way = k % 2 == 0
    e = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), k.alias("id"),
        F.when(~way, 43.5).alias("lat"), F.when(~way, -79.5).alias("lon"), tags.alias("tags"),
        F.when(way, ring).alias("geometry"))
    docs = t.customer.groupBy(F.floor(k / 200).alias("b")).agg(F.collect_list(e).alias("elements"))
    return Js.read(t.spark, landed(t, "elements", docs.select("elements")), O.ELEMENTS)


@query("a11_water_elements", """
    SELECT CASE WHEN c_custkey % 2 = 0 THEN 'way/' ELSE 'node/' END || c_custkey AS osm_id,
      CASE WHEN c_custkey % 6 = 0 THEN 'pond' ELSE 'lake' END AS feature_type,
      CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN
        round(0.01 * 0.01 * 111000.0 * 111000.0 * cos(radians(44.004)), 0) END AS area_m2
    FROM customer WHERE c_custkey % 3 = 0""")
def _(t):
    return O.water_features(osm_file(t)).select(
        "osm_id", "feature_type", "name", F.round("area_m2", 0).alias("area_m2"))


@query("a12_access_elements", """
    SELECT CASE WHEN c_custkey % 2 = 0 THEN 'way/' ELSE 'node/' END || c_custkey AS osm_id,
      CASE WHEN c_custkey % 3 = 1 THEN 'fishing_spot' ELSE 'road' END AS access_type
    FROM customer WHERE c_custkey % 3 <> 0""")
def _(t):
    return O.access_points(osm_file(t)).select("osm_id", "access_type")


@query("a13_bird_documents", """
    SELECT 'S' || event_id || '_' || CASE event_type WHEN 'view' THEN 'osprey1' ELSE 'other' END AS obs_id,
      CAST(ts AS DATE) AS observed_on, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS INTEGER) END
      AS how_many, CASE event_type WHEN 'view' THEN
        'Confirmed fish presence — osprey only hunt where fish are abundant and catchable'
        ELSE 'Piscivore — indicates fish-bearing water' END AS piscivore_significance
    FROM events WHERE event_id % 5 <> 0""")
def _(t):
    raw = t.events.select(
        F.when(F.col("event_type") == "view", "osprey1").otherwise("other").alias("speciesCode"),
        F.lit(44.0).alias("lat"), F.lit(-80.0).alias("lng"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("obsDt"),
        F.when(F.col("event_id") % 4 == 0, "X").otherwise(
            F.floor("value").cast("string")).alias("howMany"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("S"), "event_id")).alias("subId"))
    rows = Js.read(t.spark, landed(t, "birds", raw), Js.BIRDS)
    return Js.bird_observations(rows).select("obs_id", "observed_on", "how_many", "piscivore_significance")


def polygon_docs(t, props):
    from riffle.catalog.joins import octagon

    ring = F.transform(octagon(0.4503, 0.2303), lambda p: F.array(p["lng"], p["lat"]))
    small = F.transform(octagon(0.1, 0.05), lambda p: F.array(p["lng"], p["lat"]))
    multi = F.col("park_id") % 2 == 0
    g = F.when(multi, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(
        F.array(F.slice(small, 1, 4)), F.array(ring)).alias("coordinates")))).otherwise(F.to_json(F.struct(
            F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    f = F.struct(props.alias("properties"), g.alias("geometry")).alias("feature")
    path = features(t, "polygons", t.parks.select("park_id", f), "park_id")
    # geometry is written as text, as a map of raw fields would hold it
    return Js.read(t.spark, path, Pg.FEATURES)


@query("a14_park_polygons", """
    SELECT CAST(park_id AS VARCHAR) AS park_id, 'Park ' || park_id AS name, park_type,
      round(clat + 0.2303 / 9, 6) AS centroid_lat, round(clng + 0.4503 / 9, 6) AS centroid_lng FROM parks""")
def _(t):
    props = F.create_map(
        F.lit("objectid_ignored"), F.lit("x"), F.lit("OGF_ID"), F.col("park_id").cast("string"),
        F.lit("park_class"), F.concat(F.lit(" "), F.lower("park_type"), F.lit(" class")),
        F.lit("Area_Name"), F.concat(F.lit("Park "), "park_id"))
    out = Pg.parks(polygon_docs(t, props))
    kind = F.col("park_type")
    return out.select("park_id", "name", kind, F.round("centroid_lat", 6).alias("centroid_lat"),
                      F.round("centroid_lng", 6).alias("centroid_lng"))


_AREA = 4 * 0.4503**2 - 2 * (0.4503 - 0.2303) ** 2


@query("a15_crown_land_polygons", f"""
    WITH shapes AS (SELECT *, park_id % 2 = 0 AS many FROM parks),
    points AS (SELECT DISTINCT lat, lng FROM observations),
    held AS (SELECT park_id, count(*) AS n FROM points a JOIN shapes b ON
        (abs(a.lng - clng) < 0.4503 AND abs(a.lat - clat) < 0.4503 AND abs(a.lng - clng) + abs(a.lat - clat) < 0.6806
          AND NOT (many AND abs(a.lng - clng) < 0.1007 AND abs(a.lat - clat) < 0.1007))
        OR (many AND abs(a.lng - clng - 1) < 0.0503 AND abs(a.lat - clat) < 0.0503) GROUP BY 1)
    SELECT CAST(park_id AS VARCHAR) AS crown_id, 'General Use' AS land_use_type, round(clat, 6) AS centroid_lat,
      round(clng + CASE WHEN many THEN 4 * 0.0503 * 0.0503 / ({_AREA} - 4 * 0.1007 * 0.1007 + 4 * 0.0503 * 0.0503) ELSE 0 END, 6) AS centroid_lng,
      round(clng - 0.4503, 6) AS bbox_minx, round(clng + CASE WHEN many THEN 1.0503 ELSE 0.4503 END, 6) AS bbox_maxx,
      round(clat + 0.4503, 6) AS bbox_maxy, CASE WHEN many THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS kind,
      CAST(CASE WHEN many THEN 3 ELSE 1 END AS INTEGER) AS n_rings, coalesce(n, 0) AS places_inside
    FROM shapes LEFT JOIN held USING (park_id)""")
def _(t):
    """Every second area has two parts, the first with a hole; places inside are counted over the whole geometry."""
    from riffle.catalog.joins import octagon
    from riffle.operators import spatial as S

    pairs = lambda ring: F.transform(ring, lambda p: F.array(p["lng"], p["lat"]))
    square = lambda half, dx: F.array(*[F.array(F.col("clng") + dx + half * x, F.col("clat") + half * y)
                                        for x, y in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))])
    ring = pairs(octagon(0.4503, 0.2303))
    g = F.when(F.col("park_id") % 2 == 0, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(
        F.array(ring, square(0.1007, 0.0)), F.array(square(0.0503, 1.0))).alias("coordinates")))).otherwise(F.to_json(F.struct(
            F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    props = F.create_map(F.lit("OBJECTID"), F.col("park_id").cast("string"), F.lit("Land_Class"), F.lit("General Use"))
    f = F.struct(props.alias("properties"), g.alias("geometry")).alias("feature")
    out = Pg.crown_land(Js.read(t.spark, features(t, "areas", t.parks.select("park_id", f), "park_id"), Pg.FEATURES))
    held = S.polygon_pairs(t.observations, out, "rings", F.col("crown_id")).groupBy("best").agg(F.count("*").alias("places_inside"))
    return out.join(held.withColumnRenamed("best", "crown_id"), "crown_id", "left").select(
        "crown_id", "land_use_type", *[F.round(c, 6).alias(c) for c in ("centroid_lat", "centroid_lng", "bbox_minx", "bbox_maxx", "bbox_maxy")],
        F.substring_index("geom_wkt", " ", 1).alias("kind"), F.size("rings").alias("n_rings"), F.coalesce("places_inside", F.lit(0)).alias("places_inside"))


def watercourse_docs(t, copies=1):
    from riffle.functions import geo

    v = geo.wkt_vertices("geom_wkt")
    path = F.transform(v, lambda p: F.array(p["lng"], p["lat"]))
    s = t.segments.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    f = F.struct(F.struct(
        F.col("ogf_id").alias("OGF_ID"), F.when(F.col("copy") == 1, F.col("watercourse_type")).otherwise(
            "Copy").alias("WATERCOURSE_TYPE"), F.coalesce("name", F.lit("")).alias("OFFICIAL_NAME_LABEL"),
        F.when(F.col("flow_verified"), "Yes").otherwise("No").alias("FLOW_DIRECTION_VERIFIED_IND"),
        F.col("length_m").alias("SYSTEM_CALCULATED_LENGTH")).alias("attributes"),
        F.struct(F.array(path).alias("paths")).alias("geometry")).alias("feature")
    file = features(t, "watercourses", s.select("ogf_id", f), "ogf_id")
    return Js.read(t.spark, file, Js.WATERCOURSES)


@query("a16_watercourse_features", """
    SELECT ogf_id, watercourse_type, name, flow_verified, length_m, 'Permanent' AS permanency FROM segments""")
def _(t):
    return Js.stream_segments(watercourse_docs(t), (44.0, -79.5)).select(
        "ogf_id", "watercourse_type", "name", "flow_verified", "length_m", "permanency")


@query("a17_barrier_features", """
    SELECT ogf_id, barrier_type, lat, lng FROM barriers WHERE barrier_type <> 'Rocks'""")
def _(t):
    f = F.struct(F.struct(F.col("ogf_id").alias("OGF_ID"), F.when(
        F.col("barrier_type") != "Rocks", F.col("barrier_type")).alias("HYDROGRAPHIC_POINT_TYPE")).alias(
        "attributes"), F.struct(F.col("lng").alias("x"), F.col("lat").alias("y")).alias("geometry"))
    path = features(t, "barriers", t.barriers.select("ogf_id", f.alias("feature")), "ogf_id")
    return Js.barriers(Js.read(t.spark, path, Js.BARRIERS)).select("ogf_id", "barrier_type", "lat", "lng")


@query("a18_first_copy_per_id", "SELECT ogf_id, watercourse_type FROM segments")
def _(t):
    rows = Js.stream_segments(watercourse_docs(t, 2)).withColumn(
        "tile", F.when(F.col("watercourse_type") == "Copy", 2).otherwise(1))
    return Js.first_per_id(rows, "ogf_id", "tile").select("ogf_id", "watercourse_type")


@query("a19_geology_placemarks", """
    SELECT 'tile' || (unit_id % 5) AS tile, CASE unit_id % 4 WHEN 0 THEN '6a' WHEN 1 THEN '8b' ELSE '5x' END
        AS unit_code, CASE unit_id % 4 WHEN 0 THEN 'coarse' WHEN 1 THEN 'fine' ELSE 'mixed' END
        AS substrate_class, count(*) AS n, round(sum(lat), 4) AS lat_sum FROM geology
    WHERE unit_id % 4 <> 3 GROUP BY 1, 2, 3""")
def _(t):
    k = F.col("unit_id")
    code = F.when(k % 4 == 0, "6A").when(k % 4 == 1, "8b").when(k % 4 == 2, "5x").otherwise("21")
    text = lambda dy: F.concat(F.col("lng").cast("string"), F.lit(","), (F.col("lat") + dy).cast("string"))
    raw = t.geology.select(
        (k % 5).alias("tile_no"), F.concat(code, F.lit("  Deposit  "), F.col("substrate_class")).alias("name"),
        F.concat(F.lit("<b>"), F.col("substrate_class"), F.lit("</b> beds")).alias("description"),
        F.when(k % 2 == 0, F.struct(text(0.0).alias("coordinates"))).alias("Point"),
        F.array(F.struct(F.struct(F.struct(F.concat_ws(" ", text(-0.1), text(0.1)).alias(
            "coordinates")).alias("LinearRing")).alias("outerBoundaryIs"))).alias("Polygon"))
    path = folder(t, "geology")
    raw.write.partitionBy("tile_no").format("xml").option("rowTag", "Placemark").option(
        "rootTag", "Document").save(path)
    marks = K.read_placemarks(t.spark, path).withColumn("tile_id", F.concat(
        F.lit("tile"), F.regexp_extract(F.col("_metadata.file_path"), r"tile_no=(\d+)", 1)))
    units = K.geology_units(marks.drop("tile_no"))
    return units.groupBy(F.col("tile_id").alias("tile"), "unit_code", "substrate_class").agg(
        F.count("*").alias("n"), F.round(F.sum("centroid_lat"), 4).alias("lat_sum"))


@query("a20_parallel_arrays", """
    SELECT date_trunc('minute', ts) AS ts, value AS pressure FROM events WHERE event_id % 8 <> 0""")
def _(t):
    e = t.events.withColumn("b", F.floor(F.col("event_id") / 200))
    pair = F.sort_array(F.collect_list(F.struct("event_id", F.date_format(
        "ts", "yyyy-MM-dd'T'HH:mm").alias("time"), F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("v"))))
    docs = e.groupBy("b").agg(pair.alias("p")).select(F.struct(
        F.transform("p", lambda x: x["time"]).alias("time"),
        F.transform("p", lambda x: x["v"]).alias("surface_pressure")).alias("hourly"))
    path = landed(t, "hourly", docs, ignoreNullFields=False)
    return Js.hourly_pressure(Js.read(t.spark, path, Js.HISTORY)).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "pressure")


@query("a21_post_documents", """
    SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN doc_id % 2 = 0 THEN 'comment' ELSE 'post' END AS post_type,
      md5(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END) AS digest, CASE WHEN doc_id % 2 = 1 THEN source END AS title
    FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def _(t):
    k = F.col("doc_id")
    data = F.struct(
        F.concat(F.when(k % 3 == 0, "t3_").otherwise(""), k.cast("string")).alias("id"),
        F.col("source").alias("subreddit"), F.col("source").alias("title"),
        F.when(k % 9 == 0, "[deleted]").otherwise(F.col("text")).alias("selftext"),
        (k * 1000).cast("double").alias("created_utc"), (k % 11 == 0).alias("stickied"),
        F.when(k % 13 == 0, "moderator").alias("distinguished"))
    child = F.struct(F.when(k % 2 == 0, "t1").otherwise("t3").alias("kind"), data.alias("data"))
    docs = t.documents.groupBy(F.floor(k / 200).alias("b")).agg(F.collect_list(child).alias("children"))
    path = landed(t, "posts", docs.select(F.struct("children").alias("data")))
    return Js.posts(Js.read(t.spark, path, Js.POSTS)).select(
        "post_id", "post_type", F.md5("body").alias("digest"), "title")


@query("a22_json_array_file", """
    SELECT species, sara_status, jurisdiction FROM ranges""")
def _(t):
    # files that hold one array each, as they are delivered: one for each range of keys
    part = F.floor(F.col("scientific_name") / ARRAY_ROWS).alias("part")
    each = F.struct("species", "sara_status", F.array("jurisdiction").alias("jurisdictions_present"))
    files = t.ranges.groupBy(part).agg(F.to_json(F.collect_list(each)).alias("value"))
    path = landed(t, "ranges", files, "text", by=["part"])
    rows = Js.read(t.spark, path, Js.RANGES, whole_files=True)
    return rows.select("species", "sara_status", F.col("jurisdictions_present")[0].alias("jurisdiction"))


_UPSERTED = """
    WITH b AS (SELECT s_suppkey * 2 AS ogf_id, s_acctbal AS length_m, 1 AS v FROM supplier UNION ALL
        SELECT s_suppkey * 2, s_acctbal + 1, 2 FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT ogf_id, length_m FROM segments WHERE ogf_id NOT IN (SELECT ogf_id FROM b)
    UNION ALL SELECT ogf_id, arg_max(length_m, v) FROM b GROUP BY 1"""


def _updates(t):
    b = t.supplier.select((F.col("s_suppkey") * 2).alias("ogf_id"), F.col("s_acctbal").alias("length_m"),
                          F.lit(1).alias("v"))
    b = b.unionByName(t.supplier.where("s_suppkey % 3 = 0").select(
        (F.col("s_suppkey") * 2).alias("ogf_id"), (F.col("s_acctbal") + 1).alias("length_m"),
        F.lit(2).alias("v")))
    return b


@query("a23_upsert", _UPSERTED)
def _(t):
    return Tb.upsert(t.segments.select("ogf_id", "length_m"), _updates(t), ["ogf_id"], F.col("v")).select(
        "ogf_id", "length_m")


@query("a23_keyed_merge", _UPSERTED)
def _(t):
    """The same as two batches of one writer to a table in parts, the second sent twice."""
    store = KeyedStore(t.spark, folder(t, "keyed"), parts=16)
    store.merge("lengths", t.segments.select("ogf_id", "length_m"), F.lit(1), "loader", 0, ["ogf_id"])
    for _ in range(2):
        store.merge("lengths", _updates(t), F.col("v"), "loader", 1, ["ogf_id"])
    return store.read("lengths").select("ogf_id", "length_m")


@query("a24_insert_if_absent", """
    WITH g AS (SELECT station_id, date_trunc('hour', ts) AS h, min(reading_id) AS reading_id FROM gauges
        GROUP BY 1, 2), first_half AS (SELECT * FROM g WHERE station_id < 12)
    SELECT station_id, h, reading_id FROM first_half UNION ALL SELECT station_id, h, reading_id FROM g
      WHERE NOT EXISTS (SELECT 1 FROM first_half f WHERE f.station_id = g.station_id AND f.h = g.h)""")
def _(t):
    rows = t.gauges.select("station_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "reading_id")
    target = rows.where("station_id < 12").groupBy("station_id", "h").agg(
        F.min("reading_id").alias("reading_id"))
    return Tb.insert_absent(target, rows, ["station_id", "h"], F.col("reading_id"))


@query("a25_full_refresh", "SELECT ogf_id, barrier_type FROM barriers")
def _(t):
    path = folder(t, "refresh")
    t.segments.select("ogf_id", F.lit("old").alias("barrier_type")).write.parquet(path)
    t.barriers.select("ogf_id", "barrier_type").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("a26_retention", """
    SELECT reading_id FROM gauges WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY""")
def _(t):
    return Tb.keep_since(t.gauges, "ts", "2024-01-25 00:00:00", 7).select("reading_id")


@query("a27_additive_migration", """
    SELECT observation_id, species, 'open' AS geoprivacy, false AS is_obscured,
      CAST(NULL AS DOUBLE) AS obscuration_radius_km FROM observations""")
def _(t):
    from riffle.schemas import DEFAULTS, schema

    old = t.observations.select("observation_id", "species", "lat", "lng")
    return Tb.with_defaults(old, schema("observations"), DEFAULTS["observations"]).select(
        "observation_id", "species", "geoprivacy", "is_obscured", "obscuration_radius_km")


@query("a28_missing_table_and_columns", """
    SELECT f.ogf_id, CAST(NULL AS DOUBLE) AS access_score, stream_order FROM feats f""")
def _(t):
    from pyspark.sql import types as T

    shape = T.StructType.fromDDL("ogf_id bigint, access_score double")
    none = Tb.read_or_empty(t.spark, folder(t, "never-written"), shape)
    return t.feats.select("ogf_id", "stream_order").join(none, "ogf_id", "left").select(
        "ogf_id", "access_score", "stream_order")


@query("a29_reject_reasons", """
    SELECT coalesce(why, 'good') AS outcome, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 3
      THEN 'all parameters null' END AS why FROM lineitem) GROUP BY 1""")
def _(t):
    good, bad = D.field_data(D.union_variants(field_files(t)), station_rows(t))
    n = F.count("*").alias("n")
    return bad.groupBy(F.col("_reject_reason").alias("outcome")).agg(n).unionByName(
        good.agg(n).select(F.lit("good").alias("outcome"), "n"))


@query("a30_geojson_features", """
    SELECT ogf_id, round(centroid_lng, 5) AS lng, watercourse_type FROM feats""")
def _(t):
    from riffle.plans.export import features as geojson

    rows = t.feats.select("ogf_id", "centroid_lat", "centroid_lng", "watercourse_type")
    path = folder(t, "geojson")
    geojson(rows).select(F.col("feature").alias("value")).write.text(path)
    back = t.spark.read.text(path).select(F.from_json("value", """type string,
        geometry struct<type:string,coordinates:array<double>>,
        properties struct<ogf_id:bigint,watercourse_type:string>""").alias("f"))
    return back.select("f.properties.ogf_id", F.col("f.geometry.coordinates")[0].alias("lng"),
                       "f.properties.watercourse_type")


@query("a31_append_with_ids", """
    WITH top AS (SELECT max(trip_id) AS m FROM trips)
    SELECT trip_id, location_name FROM trips UNION ALL
    SELECT m + row_number() OVER (ORDER BY reason), reason FROM dismissed JOIN top ON true""")
def _(t):
    batch = t.dismissed.select(F.col("reason").alias("location_name"))
    return Tb.append_with_ids(t.trips.select("trip_id", "location_name"), batch, "trip_id",
                              ["location_name"])


@query("a32_point_update", """
    SELECT t.trip_id, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_name END, location_name) AS location_name,
      CASE WHEN s.s_suppkey IS NOT NULL THEN 'logged' ELSE status END AS status FROM trips t
    LEFT JOIN supplier s ON t.trip_id = s.s_suppkey * 5""")
def _(t):
    updates = t.supplier.select(
        (F.col("s_suppkey") * 5).alias("trip_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias(
            "location_name"), F.lit("logged").alias("status"))
    return Tb.point_update(t.trips.select("trip_id", "location_name", "status"), updates, "trip_id")


@query("a33_prediction_write", """
    SELECT ogf_id, 'Esox lucius' AS species, (ogf_id % 10) / 10.0E0 AS presence_probability,
      centroid_lat FROM feats UNION ALL
    SELECT ogf_id, species, prob, lat FROM predictions""")
def _(t):
    from riffle.plans.jobs import prediction_rows

    scores = t.spark.range(0, 1).select(F.lit(-5).cast("bigint").alias("ogf_id"), F.lit(0.5).alias(
        "probability")).unionByName(t.feats.select(
            "ogf_id", ((F.col("ogf_id") % 10) / 10.0).alias("probability")))
    batch = prediction_rows(scores, t.feats, "Esox lucius", "v1").select(
        "ogf_id", "species", "presence_probability", "centroid_lat")
    target = t.predictions.select("ogf_id", "species", F.col("prob").alias("presence_probability"),
                                  F.col("lat").alias("centroid_lat"))
    return Tb.upsert(target, batch, ["ogf_id", "species"], F.col("presence_probability"))


@query("a34_tile_index", """
    SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 't' || s_suppkey END AS tile_id, s_acctbal AS west
    FROM supplier WHERE s_suppkey % 5 <> 0""")
def _(t):
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.when(k % 2 == 0, F.col("s_name")).alias("name"),
        F.struct(F.concat(F.lit("files/t"), k.cast("string"), F.lit(".kmz")).alias("href")).alias("Link"),
        F.struct(F.struct(F.lit("45").alias("north"), F.lit("44").alias("south"), F.lit("-80").alias("east"),
                          F.when(k % 5 == 0, "?").otherwise(F.col("s_acctbal").cast("string")).alias("west")
                          ).alias("LatLonAltBox")).alias("Region"))
    path = landed(t, "index", raw, "xml", rowTag="NetworkLink", rootTag="kml")
    return K.tile_index(t.spark, path).select("tile_id", "west")


@query("a36_defaults_per_column", """
    SELECT ogf_id, coalesce(CASE WHEN ogf_id % 4 = 0 THEN NULL ELSE watercourse_type END, 'Stream')
      AS watercourse_type, 'Permanent' AS permanency, coalesce(CASE WHEN ogf_id % 5 = 0 THEN NULL ELSE
      length_m END, 0) AS length_m FROM segments""")
def _(t):
    from riffle.schemas import DEFAULTS, schema

    raw = t.segments.select(
        "ogf_id", F.when(F.col("ogf_id") % 4 != 0, F.col("watercourse_type")).alias("watercourse_type"),
        F.when(F.col("ogf_id") % 5 != 0, F.col("length_m")).alias("length_m"))
    good, _ = Tb.split_rejects(raw, P.first_reason({"no id": F.col("ogf_id").isNull()}))
    return Tb.with_defaults(good, schema("stream_segments"), DEFAULTS["stream_segments"]).select(
        "ogf_id", "watercourse_type", "permanency", "length_m")


@query("a37_flatten_current_conditions", """
    SELECT event_id AS lat, value AS temperature_c, CAST(event_id % 90 AS DOUBLE) AS cloud_pct FROM events""")
def _(t):
    from riffle.plans.weather import conditions

    raw = t.events.select(
        F.col("event_id").cast("double").alias("lat"), F.lit(-80.0).alias("lng"), F.struct(
            F.col("ts").cast("string").alias("time"), F.col("value").alias("temperature_2m"),
            (F.col("event_id") % 90).alias("cloud_cover")).alias("current"))
    path = landed(t, "current", raw)
    out = conditions(Js.read(t.spark, path, Js.CURRENT))
    return out.select(F.col("lat").cast("bigint").alias("lat"), "temperature_c", "cloud_pct")


@query("a38_cached_columns", """
    SELECT ogf_id, access_score, is_crown_land, CAST(NULL AS DOUBLE) AS untapped_score FROM scored_access""")
def _(t):
    from pyspark.sql import types as T

    path = folder(t, "scores")
    t.scored_access.write.parquet(path)
    shape = T.StructType.fromDDL(
        "ogf_id bigint, access_score double, is_crown_land boolean, untapped_score double")
    return Tb.read_or_empty(t.spark, path, shape)


@query("m1_version_chains", """
    SELECT id, row_number() OVER w AS version, lead(id) OVER w AS contradicted_by,
      lead(id) OVER w IS NULL AS is_current FROM insights
    WINDOW w AS (PARTITION BY user_id, species ORDER BY created_at, id)""")
def _(t):
    out = Tb.versions(t.insights, ["user_id", "species"], ["created_at", "id"], "id")
    return out.select("id", "version", "contradicted_by", "is_current")


@query("m2_current_only", """
    SELECT id, species, created_at FROM (SELECT *, lead(id) OVER (PARTITION BY user_id, species
      ORDER BY created_at, id) IS NULL AS cur FROM insights) WHERE cur AND contains(lower(species), 'ur')""")
def _(t):
    out = Tb.versions(t.insights, ["user_id", "species"], ["created_at", "id"], "id")
    return out.where(F.col("is_current") & P.contains_ci("species", "UR")).select(
        "id", "species", "created_at").orderBy(F.desc("created_at"), "id")


@query("m3_evidence_gate", """
    SELECT confidence, count(*) AS n FROM insights WHERE confidence <> 'unverified' GROUP BY 1""")
def _(t):
    good, _bad = Tb.split_rejects(t.insights, P.first_reason({
        "not verified": F.col("confidence") == "unverified"}))
    return good.groupBy("confidence").agg(F.count("*").alias("n"))


@query("m4_feedback_update", """
    SELECT e.event_id AS id, t.trip_id IS NOT NULL AS was_used, t.trip_id FROM events e
    LEFT JOIN trips t ON e.event_id = t.trip_id * 3""")
def _(t):
    recs = t.events.select(F.col("event_id").alias("id"), F.lit(False).alias("was_used"),
                           F.lit(None).cast("bigint").alias("trip_id"))
    marks = t.trips.select((F.col("trip_id") * 3).alias("id"), F.lit(True).alias("was_used"), "trip_id")
    return Tb.point_update(recs, marks, "id")
