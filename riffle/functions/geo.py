"""Column expressions for coordinates, distances, geometry text and rings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
KM_PER_DEGREE_LNG = 80.5
M_PER_DEGREE = 111_000.0

# Ordered boxes (label, min lat, max lat, min lng, max lng), first match wins.
JURISDICTION_BOXES = [
    ("CA-ON", 41.6, 56.9, -95.2, -74.3),
    ("US-MI", 41.7, 48.3, -90.4, -82.1),
    ("US-NY", 40.5, 45.0, -79.8, -71.8),
    ("US-OH", 38.4, 42.3, -84.8, -80.5),
    ("US-MN", 43.5, 49.4, -97.2, -89.5),
    ("US-WI", 42.5, 47.1, -92.9, -86.2),
    ("CA-QC", 44.9, 62.6, -79.8, -57.1),
    ("US-PA", 39.7, 42.3, -80.5, -74.7),
]
FMZ_BOXES = [
    (4, 43.9, 46.0, -82.0, -81.0),
    (1, 41.6, 42.9, -83.5, -78.8),
    (2, 42.0, 43.8, -83.0, -81.0),
    (3, 43.5, 45.0, -82.0, -80.5),
    (5, 43.0, 45.3, -80.5, -79.0),
    (6, 44.2, 45.2, -79.0, -77.0),
    (9, 44.5, 45.5, -76.5, -75.5),
    (8, 44.0, 45.2, -77.0, -75.8),
    (7, 44.0, 45.5, -77.5, -74.5),
    (11, 44.7, 46.5, -79.0, -77.0),
    (10, 45.0, 47.5, -78.5, -74.5),
    (13, 44.8, 46.5, -81.0, -79.5),
    (12, 45.0, 47.0, -80.5, -78.5),
    (14, 45.5, 47.5, -82.0, -79.0),
    (15, 46.0, 47.5, -84.5, -83.0),
    (16, 47.5, 49.5, -86.5, -83.0),
    (19, 49.0, 50.5, -95.2, -92.0),
    (17, 47.5, 50.0, -92.0, -86.5),
    (18, 49.0, 51.5, -95.2, -88.0),
    (20, 50.0, 56.9, -88.0, -77.0),
]
BEARINGS = [
    "north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest",
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """A column, a column name, or a plain number."""
    return F.lit(float(c)) if isinstance(c, (int, float)) else col(c)


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km on a sphere of radius 6371."""
    a1, o1, a2, o2 = num(lat1), num(lng1), num(lat2), num(lng2)
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(a2 - a1) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * half(o2 - o1)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def euclid(lat1, lng1, lat2, lng2, lat_scale: float = 1.0, lng_scale: float = 1.0) -> Column:
    """Planar distance after scaling the two axes."""
    dy = (num(lat1) - num(lat2)) * lat_scale
    dx = (num(lng1) - num(lng2)) * lng_scale
    return F.sqrt(dy * dy + dx * dx)


def scaled_km(lat1, lng1, lat2, lng2) -> Column:
    return euclid(
        num(lat1) * KM_PER_DEGREE, num(lng1) * KM_PER_DEGREE_LNG,
        num(lat2) * KM_PER_DEGREE, num(lng2) * KM_PER_DEGREE_LNG,
    )


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """One of eight compass labels from the first point to the second."""
    angle = F.pmod(
        F.degrees(F.atan2(num(lng2) - num(lng1), num(lat2) - num(lat1))), F.lit(360.0)
    )
    octant = F.floor((angle + 22.5) / 45).cast("int") % 8
    return F.element_at(F.array(*[F.lit(b) for b in BEARINGS]), octant + 1)


def in_box(lat, lng, at_lat, at_lng, dlat, dlng=None) -> Column:
    """Inclusive box around a point; plain comparisons, so it reaches the Parquet scan."""
    dlng = dlat if dlng is None else dlng
    return col(lat).between(num(at_lat) - num(dlat), num(at_lat) + num(dlat)) & col(lng).between(
        num(at_lng) - num(dlng), num(at_lng) + num(dlng)
    )


def near(lat, lng, at_lat, at_lng, radius_km) -> Column:
    """The usual radius question: a square of radius_km / 111 degrees."""
    return in_box(lat, lng, at_lat, at_lng, radius_km / KM_PER_DEGREE)


def near_stretched(lat, lng, at_lat, at_lng, radius_m: float, stretch: float = 1.4) -> Column:
    deg = radius_m / M_PER_DEGREE
    return in_box(lat, lng, at_lat, at_lng, deg, deg * stretch)


def near_cos(lat, lng, at_lat: float, at_lng: float, radius_km: float, per_deg=111.320) -> Column:
    """Box whose longitude half-width follows the latitude."""
    dlng = F.lit(radius_km) / (F.lit(per_deg) * F.cos(F.radians(num(at_lat))))
    return in_box(lat, lng, at_lat, at_lng, radius_km / KM_PER_DEGREE, dlng)


def within_haversine(lat, lng, at_lat, at_lng, radius_km) -> Column:
    """Box for the scan, then the exact circle."""
    return near_cos(lat, lng, at_lat, at_lng, radius_km * 1.02, 111.0) & (
        haversine_km(lat, lng, at_lat, at_lng) <= radius_km
    )


def box_overlap(w, s, e, n, qw, qs, qe, qn) -> Column:
    """Strict overlap of two boxes."""
    return (num(e) > num(qw)) & (num(w) < num(qe)) & (num(n) > num(qs)) & (num(s) < num(qn))


def first_box(lat, lng, boxes, otherwise=None) -> Column:
    out = None
    for label, lo_lat, hi_lat, lo_lng, hi_lng in boxes:
        hit = col(lat).between(lo_lat, hi_lat) & col(lng).between(lo_lng, hi_lng)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def jurisdiction(lat, lng) -> Column:
    return first_box(lat, lng, JURISDICTION_BOXES, "UNKNOWN")


def fmz(lat, lng) -> Column:
    return first_box(lat, lng, FMZ_BOXES)


def node_key(lng, lat) -> Column:
    """Graph node id: coordinates rounded to five places."""
    return F.concat_ws(",", F.round(num(lng), 5).cast("string"), F.round(num(lat), 5).cast("string"))


# --- geometry text and vertex arrays -------------------------------------------------------

_PAIR = r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?) (-?\d+\.?\d*(?:[eE][-+]?\d+)?)"


def wkt_vertices(wkt) -> Column:
    """WKT text to an array of (lng, lat)."""
    xs = F.regexp_extract_all(col(wkt), F.lit(_PAIR), F.lit(1))
    ys = F.regexp_extract_all(col(wkt), F.lit(_PAIR), F.lit(2))
    return F.zip_with(
        xs, ys,
        lambda x, y: F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat")),
    )


def wkt_first_vertex(wkt) -> Column:
    return F.struct(
        F.regexp_extract(col(wkt), _PAIR, 1).try_cast("double").alias("lng"),
        F.regexp_extract(col(wkt), _PAIR, 2).try_cast("double").alias("lat"),
    )


def wkt_point(wkt) -> Column:
    """(lng, lat) of a POINT text, null for anything else."""
    return F.when(col(wkt).startswith("POINT"), wkt_first_vertex(wkt))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edges_of(points) -> Column:
    """Consecutive vertex pairs of an array of (lng, lat)."""
    def pairs(p: Column) -> Column:
        n = F.size(p)
        return F.when(n >= 2, F.zip_with(
            F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1),
            lambda a, b: F.struct(
                a["lng"].alias("x1"), a["lat"].alias("y1"), b["lng"].alias("x2"), b["lat"].alias("y2")
            ),
        ))

    return once(col(points), pairs)


def _edge_len(e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    return F.sqrt(dx * dx + dy * dy)


def polyline_length(points) -> Column:
    return F.aggregate(edges_of(points), F.lit(0.0), lambda acc, e: acc + _edge_len(e))


def polyline_midpoint(points) -> Column:
    """Point half way along the line (planar degrees); a lone vertex is its own midpoint."""
    empty = F.struct(
        F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("lng"),
        F.lit(None).cast("double").alias("lat"),
    )

    def middle(line: Column) -> Column:
        half, p = line["length"] / 2, line["p"]

        def walk(acc: Column, e: Column) -> Column:
            step = _edge_len(e)
            hit = acc["lng"].isNull() & (acc["run"] + step >= half) & (step > 0)
            t = (half - acc["run"]) / step
            return F.struct(
                (acc["run"] + step).alias("run"),
                F.when(hit, e["x1"] + t * (e["x2"] - e["x1"])).otherwise(acc["lng"]).alias("lng"),
                F.when(hit, e["y1"] + t * (e["y2"] - e["y1"])).otherwise(acc["lat"]).alias("lat"),
            )

        first = F.element_at(p, 1)
        return F.when(
            (F.size(p) >= 2) & (line["length"] > 0),
            once(F.aggregate(line["edges"], empty, walk), lambda w: F.struct(w["lng"].alias("lng"), w["lat"].alias("lat"))),
        ).when(F.size(p) >= 1, F.struct(first["lng"].alias("lng"), first["lat"].alias("lat")))

    length = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + _edge_len(x))
    known = once(F.struct(col(points).alias("p")), lambda s: F.struct(s["p"].alias("p"), edges_of(s["p"]).alias("edges")))
    return once(once(known, lambda s: F.struct(s["p"].alias("p"), s["edges"].alias("edges"), length(s["edges"]).alias("length"))), middle)


def vertex_mean(points) -> Column:
    p = col(points)
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda a, v: a + v[f])
    return F.when(F.size(p) > 0, F.struct(
        (total("lng") / F.size(p)).alias("lng"), (total("lat") / F.size(p)).alias("lat")
    ))


def bbox(points) -> Column:
    p = col(points)
    xs, ys = F.transform(p, lambda v: v["lng"]), F.transform(p, lambda v: v["lat"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def is_closed(points) -> Column:
    p = col(points)
    return (F.size(p) >= 4) & (F.element_at(p, 1) == F.element_at(p, -1))


def ring_area_m2(points) -> Column:
    """Shoelace area of a closed ring on a plane scaled at its mean latitude."""
    p = col(points)
    mean_lat = vertex_mean(p)["lat"]
    kx = F.lit(M_PER_DEGREE) * F.cos(F.radians(mean_lat))
    twice = F.aggregate(
        edges_of(p), F.lit(0.0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    )
    return F.when(is_closed(p), F.abs(twice) / 2 * kx * M_PER_DEGREE)


def ring_centroid(points) -> Column:
    """Area-weighted centroid of a closed ring; the vertex mean when the ring has no area."""
    p = col(points)
    origin = F.element_at(p, 1)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        x1, x2 = e["x1"] - origin["lng"], e["x2"] - origin["lng"]
        y1, y2 = e["y1"] - origin["lat"], e["y2"] - origin["lat"]
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["x"] + (x1 + x2) * cross).alias("x"),
            (acc["y"] + (y1 + y2) * cross).alias("y"),
        )

    s = F.aggregate(edges_of(p), start, step)
    return F.when(s["a"] != 0, F.struct(
        (origin["lng"] + s["x"] / (3 * s["a"])).alias("lng"),
        (origin["lat"] + s["y"] / (3 * s["a"])).alias("lat"),
    )).otherwise(vertex_mean(p))


def shape_centroid(parts) -> Column:
    """Area-weighted centroid of a shape: an array of parts, each an array of rings, the first its outline and the
    others its holes, wound either way; the mean of the first outline's vertices when there is no area."""
    p = col(parts)
    first = F.element_at(F.element_at(p, 1), 1)
    origin = F.element_at(first, 1)
    rings = F.flatten(F.transform(p, lambda part: F.transform(part, lambda r, i: F.struct(r.alias("v"), (i > 0).alias("hole")))))
    nothing = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        x1, x2 = e["x1"] - origin["lng"], e["x2"] - origin["lng"]
        y1, y2 = e["y1"] - origin["lat"], e["y2"] - origin["lat"]
        cross = x1 * y2 - x2 * y1
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (x1 + x2) * cross).alias("x"), (acc["y"] + (y1 + y2) * cross).alias("y"))

    def add(acc: Column, ring: Column) -> Column:
        m = F.aggregate(edges_of(F.concat(ring["v"], F.slice(ring["v"], 1, 1))), nothing, step)
        way = F.signum(m["a"]) * F.when(ring["hole"], -1.0).otherwise(1.0)
        return F.struct((acc["a"] + way * m["a"]).alias("a"), (acc["x"] + way * m["x"]).alias("x"), (acc["y"] + way * m["y"]).alias("y"))

    s = F.aggregate(rings, nothing, add)
    return F.when(s["a"] > 0, F.struct(
        (origin["lng"] + s["x"] / (3 * s["a"])).alias("lng"),
        (origin["lat"] + s["y"] / (3 * s["a"])).alias("lat"),
    )).otherwise(vertex_mean(first))


def point_in_ring(lat, lng, edges) -> Column:
    """Even-odd ray cast over the edge array of an outer ring (half-open in latitude)."""
    x, y = num(lng), num(lat)

    def flip(inside: Column, e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        left_of = x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when(spans, F.when(left_of, ~inside).otherwise(inside)).otherwise(inside)

    return F.aggregate(col(edges), F.lit(False), flip)


def point_segment_distance(lat, lng, x1, y1, x2, y2) -> Column:
    """Planar distance in degrees from a point to a line piece."""
    px, py, ax, ay, bx, by = (num(c) for c in (lng, lat, x1, y1, x2, y2))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def map_links(lat, lng) -> Column:
    """Satellite map links for a point; the regional imagery only inside its extent."""
    la, lo = num(lat), num(lng)
    extent = (lo > -83) & (lo < -76) & (la > 42) & (la < 46)
    links = F.create_map(
        F.lit("google_satellite"),
        F.format_string("https://maps.google.com/?q=%.5f,%.5f&t=k&z=18", la, lo),
        F.lit("bing_satellite"),
        F.format_string("https://www.bing.com/maps?cp=%.5f~%.5f&lvl=18&style=a", la, lo),
        F.lit("swoop_2025"),
        F.when(extent, F.format_string(
            "https://geohub.lio.gov.on.ca/datasets/lio::south-western-ontario-orthophotography-"
            "project-swoop-2025-1km-index/explore?location=%.5f,%.5f,16", la, lo)),
    )
    return F.map_filter(links, lambda _, v: v.isNotNull())


def bbox_tiles(df, minx="minx", miny="miny", maxx="maxx", maxy="maxy", step: float = 0.5):
    """One row per step-degree tile of each row's box; the last row and column are clipped."""
    count = lambda lo, hi: F.greatest(
        F.ceil((F.col(hi) - F.col(lo)) / step - 1e-9), F.lit(1)
    ).cast("int")
    tiles = df.withColumn("ix", F.explode(F.sequence(F.lit(0), count(minx, maxx) - 1)))
    tiles = tiles.withColumn("iy", F.explode(F.sequence(F.lit(0), count(miny, maxy) - 1)))
    return tiles.select(
        *df.columns, "ix", "iy",
        (F.col(minx) + F.col("ix") * step).alias("tile_minx"),
        (F.col(miny) + F.col("iy") * step).alias("tile_miny"),
        F.least(F.col(maxx), F.col(minx) + (F.col("ix") + 1) * step).alias("tile_maxx"),
        F.least(F.col(maxy), F.col(miny) + (F.col("iy") + 1) * step).alias("tile_maxy"),
    )


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
