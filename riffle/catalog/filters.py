"""Filters, predicates and validity checks."""

from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.functions import geo
from riffle.functions import predicates as P

HERE = (44.0, -79.5)


@query("b1_radius_box", """
    SELECT observation_id, species, lat, lng FROM observations
    WHERE lat BETWEEN 44.0 - 25.0/111.0 AND 44.0 + 25.0/111.0
      AND lng BETWEEN -79.5 - 25.0/111.0 AND -79.5 + 25.0/111.0""")
def _(t):
    return t.observations.where(geo.near("lat", "lng", *HERE, 25.0)).select(
        "observation_id", "species", "lat", "lng")


@query("b2_stretched_box", """
    SELECT ogf_id FROM segments WHERE lat BETWEEN 44.0 - 30000/111000.0 AND 44.0 + 30000/111000.0
      AND lng BETWEEN -79.5 - 30000/111000.0*1.4 AND -79.5 + 30000/111000.0*1.4""")
def _(t):
    return t.segments.where(geo.near_stretched("lat", "lng", *HERE, 30000)).select("ogf_id")


@query("b3_box_by_latitude", """
    SELECT ogf_id FROM segments WHERE lat BETWEEN 44.0 - 40/111.0 AND 44.0 + 40/111.0
      AND lng BETWEEN -79.5 - 40/(111.320*cos(radians(44.0)))
                  AND -79.5 + 40/(111.320*cos(radians(44.0)))""")
def _(t):
    return t.segments.where(geo.near_cos("lat", "lng", *HERE, 40.0)).select("ogf_id")


HAV = ("6371.0*2*asin(sqrt(power(sin(radians({a2}-({a1}))/2),2)+cos(radians({a1}))*"
       "cos(radians({a2}))*power(sin(radians({o2}-({o1}))/2),2)))")


def hav(a1, o1, a2, o2):
    return HAV.format(a1=a1, o1=o1, a2=a2, o2=o2)


@query("b4_within_circle_sorted", f"""
    SELECT DISTINCT station_id, lat, lng, round(d, 6) AS km FROM
      (SELECT station_id, lat, lng, {hav(44.0, -79.5, 'lat', 'lng')} AS d FROM readings)
    WHERE d <= 60""")
def _(t):
    d = geo.haversine_km(F.lit(HERE[0]), F.lit(HERE[1]), "lat", "lng")
    return (
        t.readings.where(geo.within_haversine("lat", "lng", *HERE, 60.0))
        .select("station_id", "lat", "lng", F.round(d, 6).alias("km")).distinct()
        .orderBy("km", "station_id")
    )


@query("b5_circle_150km", f"""
    SELECT count(*) AS n, CAST(sum(ogf_id) AS BIGINT) AS key_sum FROM segments
    WHERE {hav(44.0, -79.5, 'lat', 'lng')} <= 150""")
def _(t):
    return t.segments.where(
        geo.haversine_km(F.lit(HERE[0]), F.lit(HERE[1]), "lat", "lng") <= 150
    ).agg(F.count("*").alias("n"), F.sum("ogf_id").alias("key_sum"))


@query("b6_box_overlap", """
    SELECT park_id FROM parks WHERE clng + 0.25 > -81 AND clng - 0.25 < -79
       AND clat + 0.25 > 43 AND clat - 0.25 < 45""")
def _(t):
    return t.parks.where(geo.box_overlap(
        F.col("clng") - 0.25, F.col("clat") - 0.25, F.col("clng") + 0.25, F.col("clat") + 0.25,
        -81.0, 43.0, -79.0, 45.0)).select("park_id")


@query("b7_contains_either_column", """
    SELECT gbif_key FROM gbif
    WHERE contains(lower(species), 'urgent') OR contains(lower(common_name), 'build')""")
def _(t):
    return t.gbif.where(
        P.contains_ci("species", "URGENT") | P.contains_ci("common_name", "Build")
    ).select("gbif_key")


@query("b8_contains_any", """
    SELECT species, count(*) AS n FROM observations WHERE lower(species) LIKE '%urgent%'
       OR lower(species) LIKE '%high%' OR lower(species) LIKE '%low%' GROUP BY species""")
def _(t):
    return t.observations.where(P.contains_any_ci(["species"], ["Urgent", "High", "Low"])).groupBy(
        "species").agg(F.count("*").alias("n"))


@query("b9_equals_ignoring_case", """
    SELECT gbif_key FROM gbif WHERE lower(species) = '2-high'""")
def _(t):
    return t.gbif.where(P.equals_ci("species", "2-HIGH")).select("gbif_key")


@query("b10_optional_conditions", """
    SELECT count(*) AS n, CAST(sum(quantity) AS BIGINT) AS q FROM stocking
    WHERE contains(lower(waterbody_name), 'red') AND year >= 1998""")
def _(t):
    cond = P.optional(
        name=P.contains_ci("waterbody_name", "red"), species=None,
        year_from=F.col("year") >= 1998, year_to=None,
    )
    return t.stocking.where(cond).agg(
        F.count("*").alias("n"), F.sum("quantity").alias("q"))


@query("b11_recent", """
    SELECT observation_id FROM observations WHERE observed_on >= DATE '2001-06-30' - 90""")
def _(t):
    return t.observations.where(P.since("observed_on", "2001-06-30", 90)).select("observation_id")


@query("b12_recent_or_undated", """
    SELECT gbif_key FROM gbif WHERE observed_on IS NULL OR observed_on >= DATE '2000-01-01' - 365""")
def _(t):
    return t.gbif.where(P.since("observed_on", "2000-01-01", 365, keep_null=True)).select("gbif_key")


@query("b13_uncertainty_cap", """
    SELECT count(*) AS n FROM gbif
    WHERE coordinate_uncertainty_m IS NULL OR coordinate_uncertainty_m <= 5000""")
def _(t):
    return t.gbif.where(P.at_most("coordinate_uncertainty_m", 5000)).agg(
        F.count("*").alias("n"))


@query("b14_in_and_not_in", """
    SELECT r.species FROM ranges r WHERE r.sara_status IN ('Threatened','Endangered',
      'Special Concern','Extirpated') OR r.ontario_status IN ('Threatened','Endangered',
      'Special Concern','Extirpated')""")
def _(t):
    risk = ["Threatened", "Endangered", "Special Concern", "Extirpated"]
    return t.ranges.where(
        F.col("sara_status").isin(risk) | F.col("ontario_status").isin(risk)).select("species")


@query("b15_min_area_if_known", """
    SELECT osm_id, feature_type FROM water WHERE feature_type NOT IN ('ditch','drain')
      AND NOT (area_m2 IS NOT NULL AND area_m2 < 50000)""")
def _(t):
    return t.water.where(
        ~F.col("feature_type").isin(P.NON_FISHABLE) & P.at_least_if_known("area_m2", 50000)
    ).select("osm_id", "feature_type")


@query("b16_culvert_exclusion", """
    WITH x AS (SELECT osm_id, osm_id % 5 + 1 AS ord, area_m2 / 300 AS dens FROM water)
    SELECT count(*) FILTER (WHERE NOT coalesce((ord <= 3 AND dens > 150) OR
             (ord <= 2 AND dens > 50), false)) AS kept,
           max(coalesce((ord <= 3 AND dens > 150) OR (ord <= 2 AND dens > 50), false)) AS filtered
    FROM x""")
def _(t):
    x = t.water.select((F.col("osm_id") % 5 + 1).alias("ord"), (F.col("area_m2") / 300).alias("dens"))
    bad = P.likely_culverted("ord", "dens")
    return x.agg(F.count_if(~bad).alias("kept"), F.max(bad).alias("filtered"))


@query("b17_region_exclusion", """
    SELECT count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS kept FROM (
      SELECT (lat < 43.20 AND lng > -79.90) OR lat < 42.80 OR lat > 46.40
             OR watercourse_type = 'Virtual Flow' AS gone FROM segments)""")
def _(t):
    gone = P.outside_map_region("lat", "lng", "watercourse_type")
    return t.segments.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def _boxes_sql(boxes, otherwise):
    arms = " ".join(
        f"WHEN lat BETWEEN {a} AND {b} AND lng BETWEEN {c} AND {d} THEN "
        + (f"'{label}'" if isinstance(label, str) else str(label))
        for label, a, b, c, d in boxes)
    return f"CASE {arms} ELSE {otherwise} END"


@query("b18_jurisdiction", f"""
    SELECT jurisdiction, count(*) AS n FROM (SELECT {_boxes_sql(geo.JURISDICTION_BOXES, "'UNKNOWN'")}
      AS jurisdiction FROM (SELECT lat - 2 AS lat, lng - 3 AS lng FROM observations)) GROUP BY 1""")
def _(t):
    moved = t.observations.select((F.col("lat") - 2).alias("lat"), (F.col("lng") - 3).alias("lng"))
    return moved.groupBy(geo.jurisdiction("lat", "lng").alias("jurisdiction")).agg(
        F.count("*").alias("n"))


@query("b19_management_zone", f"""
    SELECT zone, count(*) AS n FROM (SELECT {_boxes_sql(geo.FMZ_BOXES, "NULL")} AS zone FROM segments)
    GROUP BY 1""")
def _(t):
    return t.segments.groupBy(geo.fmz("lat", "lng").alias("zone")).agg(F.count("*").alias("n"))


@query("b20_validity_split", """
    SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (
      SELECT CASE WHEN NOT ph BETWEEN 0 AND 14 THEN 'ph out of range'
                  WHEN do_mgl < 0 THEN 'negative dissolved oxygen'
                  WHEN NOT temp_c BETWEEN -5 AND 40 THEN 'temperature out of range' END AS reason
      FROM (SELECT ph * 2 AS ph, do_mgl - 1 AS do_mgl, temp_c * 2 AS temp_c FROM readings))
    GROUP BY 1""")
def _(t):
    x = t.readings.select((F.col("ph") * 2).alias("ph"), (F.col("do_mgl") - 1).alias("do_mgl"),
                          (F.col("temp_c") * 2).alias("temp_c"))
    reason = F.coalesce(P.first_reason(P.water_quality_faults()), F.lit("valid"))
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("b21_real_coordinates", """
    SELECT count(*) AS n FROM (SELECT lat, CASE WHEN station_id % 5 = 0 THEN 0 WHEN station_id % 7 = 0
      THEN NULL ELSE lng END AS lng FROM readings)
    WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0""")
def _(t):
    x = t.readings.withColumn("lng", F.when(F.col("station_id") % 5 == 0, F.lit(0.0)).when(
        F.col("station_id") % 7 != 0, F.col("lng")))
    return x.where(P.real_coordinates()).agg(F.count("*").alias("n"))


@query("b22_map_filters", """
    SELECT ogf_id FROM (
      SELECT s.ogf_id, s.ogf_id % 7 AS stream_order,
             max(CASE WHEN p.rn = 1 THEN p.species END) AS top1,
             max(CASE WHEN p.rn = 2 THEN p.species END) AS top2
      FROM segments s JOIN (SELECT ogf_id, species, row_number() OVER
            (PARTITION BY ogf_id ORDER BY prob DESC, species) AS rn FROM predictions) p
        ON s.ogf_id = p.ogf_id GROUP BY 1, 2)
    WHERE stream_order >= 3 AND (top1 = 'Perca flavescens' OR top2 = 'Perca flavescens')""")
def _(t):
    from riffle.operators.ranking import top_two
    from riffle.plans.export import map_filter

    frame = t.segments.select("ogf_id", (F.col("ogf_id") % 7).alias("stream_order")).join(
        top_two(t.predictions, "ogf_id", "species", "prob"), "ogf_id")
    return frame.where(map_filter(min_order=3, species="Perca flavescens")).select("ogf_id")


@query("b23_probability_filter", """
    SELECT ogf_id, species, prob FROM predictions WHERE prob >= 0.6
      AND lat BETWEEN 44.0 - 50.0/111.0 AND 44.0 + 50.0/111.0
      AND lng BETWEEN -79.5 - 50.0/111.0 AND -79.5 + 50.0/111.0
      AND lower(species) = 'lepomis gibbosus'""")
def _(t):
    return t.predictions.where(
        geo.near("lat", "lng", *HERE, 50.0) & (F.col("prob") >= 0.6)
        & P.equals_ci("species", "Lepomis gibbosus")
    ).select("ogf_id", "species", "prob").orderBy(F.desc("prob"), "ogf_id")


@query("b24_equality_and_range", """
    SELECT access_type, count(*) AS n FROM access WHERE access_type = 'road' GROUP BY 1
    UNION ALL SELECT 'obscured', count(*) FROM observations WHERE is_obscured
    UNION ALL SELECT 'stocked', count(*) FROM stocking WHERE year >= 1997 AND year <= 1999""")
def _(t):
    count = F.count("*").alias("n")
    return (
        t.access.where(F.col("access_type") == "road").groupBy("access_type").agg(count)
        .unionByName(t.observations.where("is_obscured").agg(count).select(
            F.lit("obscured").alias("access_type"), "n"))
        .unionByName(t.stocking.where(F.col("year").between(1997, 1999)).agg(count).select(
            F.lit("stocked").alias("access_type"), "n"))
    )


@query("b25_lookup_by_key", """
    SELECT trip_id, location_name, status FROM trips
    WHERE trip_id IN (SELECT s_suppkey FROM supplier)""")
def _(t):
    from riffle.operators.tables import lookup

    keys = t.supplier.select(F.col("s_suppkey").alias("trip_id"))
    return lookup(t.trips, keys, "trip_id").select("trip_id", "location_name", "status")


@query("b26_source_constraints", """
    SELECT gbif_key FROM gbif WHERE basis_of_record IN ('FOSSIL_SPECIMEN','LITERATURE',
      'LIVING_SPECIMEN','MACHINE_OBSERVATION','MATERIAL_SAMPLE','PRESERVED_SPECIMEN')
      AND lat BETWEEN 44.0 - 100.0/111.0 AND 44.0 + 100.0/111.0
      AND lng BETWEEN -79.5 - 100.0/111.0 AND -79.5 + 100.0/111.0""")
def _(t):
    return t.gbif.where(
        F.col("basis_of_record").isin(P.OCCURRENCE_BASIS) & geo.near("lat", "lng", *HERE, 100.0)
    ).select("gbif_key")
