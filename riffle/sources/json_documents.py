"""Nested JSON responses landed as files, flattened to rows by explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions import text as X
from riffle.operators.ranking import first_per_group
from riffle.operators.aggregates import lookup
from riffle.plans.birds import DEFAULT_SIGNIFICANCE, SIGNIFICANCE

# Shapes of the responses.
OBSERVATIONS = """results array<struct<id:bigint, taxon:struct<id:bigint,name:string,
    preferred_common_name:string>, location:string, observed_on:string, quality_grade:string,
    geoprivacy:string, photos:array<struct<url:string>>, user:struct<login:string>,
    place_guess:string>>"""
OCCURRENCES = """results array<struct<key:bigint, taxonKey:bigint, speciesKey:bigint, species:string,
    scientificName:string, vernacularName:string, decimalLatitude:double, decimalLongitude:double,
    eventDate:string, countryCode:string, datasetName:string, basisOfRecord:string,
    coordinateUncertaintyInMeters:double>>"""
STATIONS = """features array<struct<id:string, geometry:struct<type:string,
    coordinates:array<double>>, properties:struct<STATION_NUMBER:string,IDENTIFIER:string,
    STATION_NAME:string,PROV_TERR_STATE_LOC:string,STATUS_EN:string,REAL_TIME:int>>>"""
READINGS = """features array<struct<properties:struct<STATION_NUMBER:string,STATION_NAME:string,
    DATETIME:string,DATE_TIME:string,LEVEL:string,DISCHARGE:string,LEVEL_SYMBOL_EN:string,
    LEVEL_GRADE:string>>>"""
BIRDS = """speciesCode string, comName string, sciName string, locName string, obsDt string,
    howMany string, lat double, lng double, subId string"""
WATERCOURSES = """features array<struct<attributes:struct<OGF_ID:bigint,WATERCOURSE_TYPE:string,
    OFFICIAL_NAME_LABEL:string,FLOW_DIRECTION_VERIFIED_IND:string,PERMANENCY:string,
    FLOW_CLASSIFICATION:string,SYSTEM_CALCULATED_LENGTH:double>,
    geometry:struct<paths:array<array<array<double>>>>>>"""
BARRIERS = """features array<struct<attributes:struct<OGF_ID:bigint,HYDROGRAPHIC_POINT_TYPE:string>,
    geometry:struct<x:double,y:double>>>"""
POSTS = """data struct<children:array<struct<kind:string, data:struct<id:string,subreddit:string,
    title:string,selftext:string,body:string,permalink:string,author:string,score:double,
    num_comments:double,created_utc:double,stickied:boolean,distinguished:string>>>>"""
FORECAST = """daily struct<time:array<string>, temperature_2m_max:array<double>,
    temperature_2m_min:array<double>, precipitation_sum:array<double>,
    wind_speed_10m_max:array<double>, weather_code:array<int>>"""
HISTORY = "hourly struct<time:array<string>, surface_pressure:array<double>>"
CURRENT = """lat double, lng double, current struct<time:string,temperature_2m:double,
    relative_humidity_2m:int,precipitation:double,wind_speed_10m:double,surface_pressure:double,
    cloud_cover:int,weather_code:int>"""
RANGES = """species string, scientific_name string, native_to_ontario boolean,
    native_to_great_lakes boolean, introduced boolean, extirpated_from_ontario boolean,
    general_range string, habitat_notes string, jurisdictions_present array<string>,
    sara_status string, ontario_status string, cosewic_status string, fishing_notes string"""
# Occurrence record kinds asked for; people's own records come from elsewhere.
SIMPLIFY_BEYOND_KM = 75.0
OBSCURED_RADIUS_KM = 22.0


def read(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """One document per line, or per file."""
    return spark.read.schema(schema).option("multiLine", whole_files).json(path)


def _each(df: DataFrame, array: str) -> DataFrame:
    return df.select(F.explode(array).alias("x"))


def observations(docs: DataFrame) -> DataFrame:
    x = _each(docs, "results").where(F.coalesce(F.col("x.location"), F.lit("")) != "")
    part = lambda i: F.split_part(F.col("x.location"), F.lit(","), F.lit(i)).try_cast("double")
    privacy = F.coalesce(F.nullif("x.geoprivacy", F.lit("")), F.lit("open"))
    hidden = privacy == "obscured"
    out = x.select(
        F.col("x.id").alias("observation_id"), F.coalesce("x.taxon.name", F.lit("Unknown")).alias(
            "species"), F.col("x.taxon.preferred_common_name").alias("common_name"),
        F.col("x.taxon.id").alias("taxon_id"), part(1).alias("lat"), part(2).alias("lng"),
        F.try_to_date("x.observed_on", "yyyy-MM-dd").alias("observed_on"),
        F.coalesce("x.quality_grade", F.lit("")).alias("quality_grade"),
        F.try_element_at("x.photos", F.lit(1))["url"].alias("photo_url"),
        F.col("x.user.login").alias("observer"), F.col("x.place_guess").alias("place_guess"),
        privacy.alias("geoprivacy"), hidden.alias("is_obscured"),
        F.when(hidden, OBSCURED_RADIUS_KM).alias("obscuration_radius_km"))
    return out.withColumn("jurisdiction", geo.jurisdiction("lat", "lng"))


def occurrences(docs: DataFrame) -> DataFrame:
    x = _each(docs, "results").where(
        "x.decimalLatitude IS NOT NULL AND x.decimalLongitude IS NOT NULL")
    out = x.select(
        F.col("x.key").alias("gbif_key"),
        F.coalesce(F.nullif("x.species", F.lit("")), "x.scientificName", F.lit("Unknown")).alias(
            "species"), F.col("x.vernacularName").alias("common_name"),
        F.coalesce("x.taxonKey", "x.speciesKey", F.lit(0)).alias("taxon_key"),
        F.col("x.decimalLatitude").alias("lat"), F.col("x.decimalLongitude").alias("lng"),
        F.try_to_date(F.left("x.eventDate", F.lit(10)), "yyyy-MM-dd").alias("observed_on"),
        F.col("x.countryCode").alias("country_code"), F.col("x.datasetName").alias("dataset_name"),
        F.coalesce("x.basisOfRecord", F.lit("UNKNOWN")).alias("basis_of_record"),
        F.col("x.coordinateUncertaintyInMeters").alias("coordinate_uncertainty_m"))
    return out.withColumn("jurisdiction", geo.jurisdiction("lat", "lng"))


def gauge_stations(docs: DataFrame) -> DataFrame:
    p = F.col("x.properties")
    xy = F.col("x.geometry.coordinates")
    return _each(docs, "features").where(
        (p["STATUS_EN"] == "Active") & (F.size(xy) >= 2)).select(
        F.coalesce(F.nullif(p["STATION_NUMBER"], F.lit("")), p["IDENTIFIER"], F.lit("")).alias(
            "station_id"), F.coalesce(p["STATION_NAME"], F.lit("")).alias("station_name"),
        p["PROV_TERR_STATE_LOC"].alias("province"), xy[1].alias("lat"), xy[0].alias("lng"),
        F.coalesce(p["REAL_TIME"], F.lit(0)).alias("real_time"))


def gauge_readings(docs: DataFrame) -> DataFrame:
    p = F.col("x.properties")
    when = F.coalesce(F.nullif(p["DATETIME"], F.lit("")), F.nullif(p["DATE_TIME"], F.lit("")))
    grade = F.coalesce(F.nullif(p["LEVEL_SYMBOL_EN"], F.lit("")), p["LEVEL_GRADE"])
    return _each(docs, "features").select(
        p["STATION_NUMBER"].alias("station_id"), p["STATION_NAME"].alias("station_name"),
        F.try_to_timestamp(when).alias("reading_datetime"),
        X.number(p["LEVEL"]).alias("water_level_m"), X.number(p["DISCHARGE"]).alias("discharge_cms"),
        grade.alias("level_grade")).where("reading_datetime IS NOT NULL")


def bird_observations(rows: DataFrame) -> DataFrame:
    """``rows`` are the array elements: a JSON array file reads as one row per element."""
    ok = (F.coalesce("subId", F.lit("")) != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    out = rows.where(ok).select(
        F.concat_ws("_", "subId", "speciesCode").alias("obs_id"),
        F.col("speciesCode").alias("species_code"),
        F.coalesce("comName", F.lit("")).alias("common_name"),
        F.nullif("sciName", F.lit("")).alias("scientific_name"), "lat", "lng",
        F.try_to_date(F.left("obsDt", F.lit(10)), "yyyy-MM-dd").alias("observed_on"),
        F.col("howMany").try_cast("int").alias("how_many"),
        F.nullif("locName", F.lit("")).alias("location_name"),
        lookup(SIGNIFICANCE, F.col("speciesCode"), DEFAULT_SIGNIFICANCE).alias(
            "piscivore_significance"))
    return out.where("observed_on IS NOT NULL").withColumn(
        "jurisdiction", geo.jurisdiction("lat", "lng"))


def _vertices(path: Column) -> Column:
    return F.transform(path, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))


def stream_segments(docs: DataFrame, home: tuple[float, float] | None = None) -> DataFrame:
    """Segments with end nodes; far from home only a point is kept as geometry."""
    a = F.col("x.attributes")
    path = F.try_element_at("x.geometry.paths", F.lit(1))
    x = _each(docs, "features").where((F.size(path) >= 2) & a["OGF_ID"].isNotNull())
    x = x.withColumn("v", _vertices(path))
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    pair = lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("v", pair), ", "), F.lit(")"))
    geom = line
    if home:
        mid = _line_centroid(F.col("v"))
        far = geo.haversine_km(home[0], home[1], mid["lat"], mid["lng"]) > SIMPLIFY_BEYOND_KM
        geom = F.when(far, F.concat(F.lit("POINT ("), pair(mid), F.lit(")"))).otherwise(line)
    return x.select(
        a["OGF_ID"].alias("ogf_id"),
        F.coalesce(F.nullif(a["WATERCOURSE_TYPE"], F.lit("")), F.lit("Stream")).alias(
            "watercourse_type"),
        F.nullif(a["OFFICIAL_NAME_LABEL"], F.lit("")).alias("name"),
        F.coalesce(a["FLOW_DIRECTION_VERIFIED_IND"] == "Yes", F.lit(False)).alias("flow_verified"),
        F.coalesce(F.nullif(a["PERMANENCY"], F.lit("")), F.lit("Permanent")).alias("permanency"),
        F.nullif(a["FLOW_CLASSIFICATION"], F.lit("")).alias("flow_classification"),
        F.coalesce(a["SYSTEM_CALCULATED_LENGTH"], F.lit(0.0)).alias("length_m"),
        geom.alias("geom_wkt"), geo.node_key(first["lng"], first["lat"]).alias("start_node"),
        geo.node_key(last["lng"], last["lat"]).alias("end_node"),
        F.lit("CA-ON").alias("jurisdiction"))


def _line_centroid(v: Column) -> Column:
    """Length-weighted centroid of a polyline; its first vertex when it has no length."""
    start = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        d = F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"]))
        return F.struct((acc["l"] + d).alias("l"), (acc["x"] + d * (e["x1"] + e["x2"]) / 2).alias("x"),
                        (acc["y"] + d * (e["y1"] + e["y2"]) / 2).alias("y"))

    s = F.aggregate(geo.edges_of(v), start, add)
    first = F.element_at(v, 1)
    return F.struct(F.when(s["l"] > 0, s["x"] / s["l"]).otherwise(first["lng"]).alias("lng"),
                    F.when(s["l"] > 0, s["y"] / s["l"]).otherwise(first["lat"]).alias("lat"))


def barriers(docs: DataFrame) -> DataFrame:
    g, a = F.col("x.geometry"), F.col("x.attributes")
    ok = (F.coalesce(a["HYDROGRAPHIC_POINT_TYPE"], F.lit("")) != "") & g["x"].isNotNull() & g["y"].isNotNull()
    return _each(docs, "features").where(ok & a["OGF_ID"].isNotNull()).select(
        a["OGF_ID"].alias("ogf_id"), a["HYDROGRAPHIC_POINT_TYPE"].alias("barrier_type"),
        F.concat(F.lit("POINT ("), g["x"].cast("string"), F.lit(" "), g["y"].cast("string"),
                 F.lit(")")).alias("geom_wkt"),
        g["y"].alias("lat"), g["x"].alias("lng"), F.lit("CA-ON").alias("jurisdiction"))


def snap_barriers(points: DataFrame, segments: DataFrame, bound_deg: float = 0.002) -> DataFrame:
    """Barriers with the segment they lie on and the distance in metres, null beyond the bound."""
    from riffle.operators.spatial import nearest_line

    lines = segments.select("ogf_id", geo.wkt_vertices("geom_wkt").alias("v")).where(F.size("v") >= 2)
    found = nearest_line(points, lines, bound_deg, "ogf_id", "v").select(
        "l_lat", "l_lng", F.col("ogf_id").alias("nearest_segment_ogf_id"),
        F.round(F.col("distance") * geo.M_PER_DEGREE, 1).alias("snap_distance_m"))
    return points.join(
        found, (points["lat"] == found["l_lat"]) & (points["lng"] == found["l_lng"]), "left"
    ).drop("l_lat", "l_lng")


def first_per_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbouring tiles repeat features on their border: the first tile's copy stays."""
    return first_per_group(rows, [key], [F.col(order)])


def posts(docs: DataFrame) -> DataFrame:
    d = F.col("x.data")
    x = docs.select(F.explode("data.children").alias("x")).where(
        d.isNotNull() & ~F.coalesce(d["stickied"], F.lit(False))
        & (F.coalesce(d["distinguished"], F.lit("")) != "moderator")
        & (F.coalesce(d["id"], F.lit("")) != ""))
    kind = F.when(F.col("x.kind") == "t1", "comment").otherwise("post")
    raw = F.coalesce(F.nullif(d["selftext"], F.lit("")), F.nullif(d["body"], F.lit("")), F.lit(""))
    link = F.coalesce(d["permalink"], F.lit(""))
    out = x.select(
        F.regexp_replace(d["id"], "^(t3_|t1_)", "").alias("post_id"),
        F.coalesce(d["subreddit"], F.lit("")).alias("subreddit"), kind.alias("post_type"),
        F.when(kind == "post", d["title"]).alias("title"),
        F.when(raw.isin("[deleted]", "[removed]"), "").otherwise(raw).alias("body"),
        F.when(link != "", F.concat(F.lit("https://www.reddit.com"), link)).otherwise("").alias("url"),
        F.coalesce(d["author"], F.lit("[deleted]")).alias("author"),
        F.coalesce(d["score"], F.lit(0.0)).cast("int").alias("score"),
        F.coalesce(d["num_comments"], F.lit(0.0)).cast("int").alias("num_comments"),
        F.timestamp_seconds(F.coalesce(d["created_utc"], F.lit(0.0))).alias("created_utc"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "body")
    return out.withColumns({
        "extracted_species": X.tag_species(text), "extracted_locations": X.tag_places(text),
        "jurisdiction": X.infer_jurisdiction(F.col("subreddit"), text)})


def forecast(docs: DataFrame) -> DataFrame:
    """Parallel arrays to one row per day."""
    d = lambda f: F.col(f"daily.{f}")
    zipped = F.arrays_zip(d("time"), d("temperature_2m_max"), d("temperature_2m_min"),
                          d("precipitation_sum"), d("wind_speed_10m_max"), d("weather_code"))
    return docs.select(F.inline(zipped)).select(
        F.try_to_date("time", "yyyy-MM-dd").alias("day"),
        F.col("temperature_2m_max").alias("temp_max_c"), F.col("temperature_2m_min").alias("temp_min_c"),
        F.col("precipitation_sum").alias("precipitation_mm"),
        F.col("wind_speed_10m_max").alias("wind_max_kmh"), "weather_code")


def hourly_pressure(docs: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"),
                          F.col("hourly.surface_pressure").alias("pressure"))
    return docs.select(F.inline(zipped)).select(
        F.try_to_timestamp("time").alias("ts"), "pressure").where("pressure IS NOT NULL")
