"""Polygon sources: parks, authority boundaries and crown land from GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo

# Field names tried in order, and the wording of park types.
FEATURES = "features array<struct<properties:map<string,string>, geometry:string>>"
PARK_TYPE_FIELDS = ["PROVINCIAL_PARK_CLASS_ENG", "PROTECTED_AREA_TYPE", "PARK_CLASS", "CLASS"]
PARK_NAME_FIELDS = ["PROTECTED_AREA_NAME_ENG", "COMMON_SHORT_NAME", "REGULATED_AREA_NAME",
                    "AREA_NAME", "NAME"]
PARK_ID_FIELDS = ["OGF_ID", "PROTECTED_SITE_IDENT", "OBJECTID", "FID"]
AUTHORITY_NAME_FIELDS = ["OFFICIAL_CONSERVATION_AUTHORITY_NAME", "CA_NAME", "AUTHORITY_NAME", "NAME"]
AUTHORITY_ID_FIELDS = ["OBJECTID", "FID", "OBJECTID_1", "CA_ID"]
CROWN_TYPE_FIELDS = ["LAND_USE_TYPE", "CROWN_LAND_USE_DESIGNATION", "DESIGNATION_TYPE", "LAND_CLASS",
                     "CLASS"]
CROWN_ID_FIELDS = ["OGF_ID", "OBJECTID", "FID", "GID"]
PARK_TYPES = [
    ("wilderness", "Wilderness"), ("nature reserve", "Nature Reserve"),
    ("naturereserve", "Nature Reserve"), ("cultural heritage", "Cultural Heritage"),
    ("culturalheritage", "Cultural Heritage"), ("natural environment", "Natural Environment"),
    ("naturalenvironment", "Natural Environment"), ("waterway", "Waterway"),
    ("recreational", "Recreational"),
]
_POLYGON = "struct<type:string, coordinates:array<array<array<double>>>>"
_MULTI = "struct<type:string, coordinates:array<array<array<array<double>>>>>"


def park_type(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    out = F.initcap(F.trim(raw))
    for word, kind in reversed(PARK_TYPES):
        out = F.when(low.contains(word), F.lit(kind)).otherwise(out)
    return out


def _first(props: Column, names: list[str]) -> Column:
    upper = F.transform_keys(props, lambda k, _: F.upper(k))
    return F.coalesce(*[upper[n] for n in names])


def _exact(props: Column, names: list[str]) -> Column:
    return F.coalesce(*[props[n] for n in names])


def _with_rings(docs: DataFrame) -> DataFrame:
    """Features with ``parts`` (all polygons, each an array of rings of vertices) and ``rings`` as arrays of
    [lng, lat]: of several polygons the one whose outer ring has most points."""
    x = docs.select(F.explode("features").alias("x")).select(
        F.col("x.properties").alias("props"), F.col("x.geometry").alias("geometry"))
    kind = F.get_json_object("geometry", "$.type")
    single = F.from_json("geometry", _POLYGON)["coordinates"]
    multi = F.from_json("geometry", _MULTI)["coordinates"]
    biggest = F.array_max(F.transform(multi, lambda p, i: F.struct(
        F.size(F.try_element_at(p, F.lit(1))).alias("n"), (-i).alias("o"), p.alias("p"))))["p"]
    rings = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", biggest)
    out = x.withColumn("rings", rings).where(
        F.size(F.try_element_at("rings", F.lit(1))) > 0)
    ring = F.transform(F.element_at("rings", 1), lambda p: F.struct(
        p[0].alias("lng"), p[1].alias("lat")))
    vertices = lambda r: F.transform(r, lambda v: F.struct(v[0].alias("lng"), v[1].alias("lat")))
    whole = F.when(kind == "Polygon", F.array(single)).otherwise(multi)
    parts = F.filter(F.transform(whole, lambda p: F.filter(F.transform(p, vertices), lambda r: F.size(r) > 0)), lambda p: F.size(p) > 0)
    return out.withColumn("ring", ring).withColumn("parts", parts)


def parks(docs: DataFrame) -> DataFrame:
    p = F.col("props")
    kind = F.coalesce(_first(p, PARK_TYPE_FIELDS), F.lit("unknown"))
    name = F.coalesce(_first(p, PARK_NAME_FIELDS), F.lit("Unknown Park"))
    made = F.replace(F.lower(F.concat_ws("_", name, kind)), F.lit(" "), F.lit("_"))
    c = geo.vertex_mean("ring")
    return _with_rings(docs).select(
        F.coalesce(_exact(p, PARK_ID_FIELDS), made).alias("park_id"), name.alias("name"),
        park_type(kind).alias("park_type"), c["lat"].alias("centroid_lat"),
        c["lng"].alias("centroid_lng"), F.to_json("rings").alias("polygon_json"), "ring")


def authorities(docs: DataFrame) -> DataFrame:
    p = F.col("props")
    name = F.coalesce(_first(p, AUTHORITY_NAME_FIELDS), F.lit("Unknown CA"))
    made = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    c = geo.vertex_mean("ring")
    return _with_rings(docs).select(
        F.coalesce(_exact(p, AUTHORITY_ID_FIELDS), made).alias("ca_id"), name.alias("name"),
        c["lat"].alias("centroid_lat"), c["lng"].alias("centroid_lng"),
        F.to_json("rings").alias("polygon_json"), "ring")


def crown_land(docs: DataFrame) -> DataFrame:
    """Whole geometry as stored (no simplification): all parts and holes as text and as ``rings``, with the
    box and the area-weighted centroid of them all."""
    p = F.col("props")
    c = geo.shape_centroid("parts")
    every = F.flatten("parts")
    b = geo.bbox(F.flatten(every))
    pair = lambda v: F.concat_ws(" ", v["lng"].cast("string"), v["lat"].cast("string"))
    listed = lambda items: F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))
    text = F.transform("parts", lambda part: listed(F.transform(part, lambda r: listed(F.transform(r, pair)))))
    wkt = F.when(F.size("parts") == 1, F.concat(F.lit("POLYGON "), text[0])).otherwise(F.concat(F.lit("MULTIPOLYGON "), listed(text)))
    return _with_rings(docs).select(
        _exact(p, CROWN_ID_FIELDS).alias("crown_id"),
        F.coalesce(_first(p, CROWN_TYPE_FIELDS), F.lit("Crown Land")).alias("land_use_type"),
        wkt.alias("geom_wkt"), c["lat"].alias("centroid_lat"), c["lng"].alias("centroid_lng"),
        *[b[k].alias(f"bbox_{k}") for k in ("minx", "miny", "maxx", "maxy")], "ring", every.alias("rings"),
    ).where("crown_id IS NOT NULL")


def stored_ring(polygon_json: str | Column) -> Column:
    """Outer ring of a stored polygon_json text; rings under four points are no polygon."""
    c = F.col(polygon_json) if isinstance(polygon_json, str) else polygon_json
    ring = F.try_element_at(F.from_json(c, "array<array<array<double>>>"), F.lit(1))
    v = F.transform(ring, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))
    return F.when(F.size(v) >= 4, v)
