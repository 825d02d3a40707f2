"""Map elements with tags to water features and access points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo

# Shape of the elements, ordered tag rules (tag, value, type).
ELEMENTS = """elements array<struct<type:string, id:bigint, lat:double, lon:double,
    tags:map<string,string>, geometry:array<struct<lat:double,lon:double>>>>"""
WATER_RULES = [
    ("waterway", "river", "river"), ("waterway", "stream", "stream"), ("waterway", "canal", "canal"),
    ("waterway", "ditch", "ditch"), ("waterway", "drain", "drain"), ("natural", "wetland", "wetland"),
    ("natural", "bay", "bay"),
]
STANDING_WATER = {"pond": "pond", "reservoir": "reservoir"}
ACCESS_RULES = [
    ("amenity", "boat_ramp", "boat_launch"), ("leisure", "fishing", "fishing_spot"),
    ("highway", "trailhead", "trail_head"), ("leisure", "nature_reserve", "conservation_area"),
    ("boundary", "protected_area", "public_land"), ("leisure", "park", "park"),
    ("highway", "layby", "parking"), ("amenity", "parking", "parking"),
    ("highway", "primary", "road"), ("highway", "secondary", "road"),
    ("highway", "tertiary", "road"), ("highway", "unclassified", "road"),
]


def _rules(tags: Column, rules) -> list[Column]:
    return [F.when(tags[tag] == value, F.lit(kind)) for tag, value, kind in rules]


def water_type(tags: Column) -> Column:
    standing = F.lit("lake")
    for value, kind in STANDING_WATER.items():
        standing = F.when(tags["water"] == value, F.lit(kind)).otherwise(standing)
    return F.coalesce(*_rules(tags, WATER_RULES), F.when(tags["natural"] == "water", standing))


def access_type(tags: Column) -> Column:
    return F.coalesce(*_rules(tags, ACCESS_RULES), F.when(
        F.coalesce(tags["building"], F.lit("")) != "", F.lit("building")))


def _placed(docs: DataFrame) -> DataFrame:
    x = docs.select(F.explode("elements").alias("x"))
    ring = F.transform("x.geometry", lambda p: F.struct(p["lon"].alias("lng"), p["lat"].alias("lat")))
    x = x.withColumn("ring", ring).withColumn("tags", F.coalesce(
        "x.tags", F.create_map().cast("map<string,string>")))
    mean = geo.vertex_mean("ring")
    node = F.col("x.type") == "node"
    return x.withColumns({
        "lat": F.when(node, F.col("x.lat")).otherwise(mean["lat"]),
        "lng": F.when(node, F.col("x.lon")).otherwise(mean["lng"]),
    }).where("lat IS NOT NULL AND lng IS NOT NULL")


def _common() -> list[Column]:
    return [F.concat_ws("/", "x.type", F.col("x.id").cast("string")).alias("osm_id"),
            F.nullif(F.col("tags")["name"], F.lit("")).alias("name"), F.col("lat"), F.col("lng"),
            geo.jurisdiction("lat", "lng").alias("jurisdiction"), F.col("tags")]


def water_features(docs: DataFrame) -> DataFrame:
    area = F.when(F.col("x.type") == "way", geo.ring_area_m2("ring"))
    return _placed(docs).select(
        *_common(), water_type(F.col("tags")).alias("feature_type"), area.alias("area_m2")
    ).where("feature_type IS NOT NULL")


def access_points(docs: DataFrame) -> DataFrame:
    return _placed(docs).select(
        *_common(), access_type(F.col("tags")).alias("access_type")
    ).where("access_type IS NOT NULL")
