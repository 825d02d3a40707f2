"""KML sources: geology placemarks and the tile index, through the XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.text import strip_html
from riffle.operators.aggregates import lookup
from riffle.operators.windows import numbered_with_next

# Shapes, and substrate class per unit code (21 is man-made and skipped).
PLACEMARK = """name string, description string, Point struct<coordinates:string>,
    MultiGeometry struct<Point:struct<coordinates:string>,
      Polygon:array<struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>>,
    Polygon array<struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>"""
NETWORK_LINK = """name string, Link struct<href:string>,
    Region struct<LatLonAltBox:struct<north:string,south:string,east:string,west:string>>"""
SUBSTRATES = {
    "1": "bedrock", "2": "bedrock", "3": "bedrock", "4": "bedrock", "5a": "mixed", "5b": "mixed",
    "5c": "mixed", "5d": "mixed", "5e": "mixed", "6": "coarse", "6a": "coarse", "7": "coarse",
    "8a": "fine", "8b": "fine", "9": "coarse", "9a": "coarse", "9b": "coarse", "9c": "coarse",
    "20": "organic",
}
MAN_MADE = "21"


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with the file they come from; the tile is the file's name."""
    df = spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK).load(path)
    return df.withColumn("tile_id", F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))


def _points(text: Column) -> Column:
    """'lng,lat,alt ...' to vertices; unreadable tokens drop out."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t.contains(","))
    v = F.transform(tokens, lambda t: F.struct(
        F.split_part(t, F.lit(","), F.lit(1)).try_cast("double").alias("lng"),
        F.split_part(t, F.lit(","), F.lit(2)).try_cast("double").alias("lat")))
    return F.filter(v, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())


def _rings(polygons: Column) -> Column:
    return F.array_join(F.transform(
        polygons, lambda p: p["outerBoundaryIs"]["LinearRing"]["coordinates"]), " ")


def geology_units(placemarks: DataFrame) -> DataFrame:
    name = F.trim("name")
    code = F.lower(F.split_part(F.regexp_replace(name, r"\s+", " "), F.lit(" "), F.lit(1)))
    rest = F.trim(F.regexp_extract(name, r"^\S+\s+(.*)$", 1))
    spot = F.coalesce("MultiGeometry.Point.coordinates", "Point.coordinates")
    every = _points(F.concat_ws(" ", spot, _rings(F.col("MultiGeometry.Polygon")),
                                _rings(F.col("Polygon"))))
    x = placemarks.where(F.coalesce(name, F.lit("")) != "").select(
        "tile_id", code.alias("unit_code"),
        F.when(rest != "", rest).otherwise(name).alias("unit_name"),
        F.nullif(strip_html("description"), F.lit("")).alias("primary_material"),
        F.try_element_at(_points(spot), F.lit(1)).alias("at"), every.alias("v"),
        F.monotonically_increasing_id().alias("_order"))
    x = x.where((F.col("unit_code") != MAN_MADE) & (F.size("v") > 0)).withColumn("b", geo.bbox("v"))
    x = numbered_with_next(x.drop("v"), ["tile_id"], ["_order"], "_n", "_order", "_next")
    mid = lambda lo, hi: (F.col(f"b.{lo}") + F.col(f"b.{hi}")) / 2
    return x.select(
        F.concat_ws("_", "tile_id", F.lpad((F.col("_n") - 1).cast("string"), 4, "0")).alias("unit_id"),
        "tile_id", "unit_code", "unit_name", "primary_material",
        lookup(SUBSTRATES, F.col("unit_code"), "mixed").alias("substrate_class"),
        F.lit("CA-ON").alias("jurisdiction"),
        F.coalesce("at.lat", mid("miny", "maxy")).alias("centroid_lat"),
        F.coalesce("at.lng", mid("minx", "maxx")).alias("centroid_lng"),
        *[F.col(f"b.{k}").alias(f"bbox_{k}") for k in ("minx", "miny", "maxx", "maxy")])


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """Tiles with link and box; a missing name falls back to the linked file's."""
    df = spark.read.format("xml").option("rowTag", "NetworkLink").schema(NETWORK_LINK).load(path)
    href = F.trim("Link.href")
    side = lambda s: F.trim(f"Region.LatLonAltBox.{s}").try_cast("double").alias(s)
    stem = F.regexp_extract(href, r"([^/]+?)(\.kmz)?$", 1)
    return df.select(
        F.coalesce(F.nullif(F.trim("name"), F.lit("")), stem).alias("tile_id"), href.alias("href"),
        side("west"), side("south"), side("east"), side("north"),
    ).where("href <> '' AND west IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL "
            "AND north IS NOT NULL")
