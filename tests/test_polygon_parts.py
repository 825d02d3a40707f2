"""Points in polygons with parts and holes, and in rings of very many vertices."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riffle.operators import spatial as S

RINGS = "k int, rings array<array<struct<lng:double,lat:double>>>"


def ring(points):
    return [{"lng": float(x), "lat": float(y)} for x, y in points]


def circle(x, y, radius, n, wave=0.0):
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = radius * (1 + wave * np.sin(9 * a))
    return list(zip(x + r * np.cos(a), y + r * np.sin(a)))


def inside(x, y, rings):
    hit = np.zeros(len(x), bool)
    for points in rings:
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            if y1 != y2:
                hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit


def test_parts_and_holes(spark):
    polys = [
        (1, [circle(-80, 44, 0.4, 30), circle(-80, 44, 0.2, 12), circle(-80, 44, 0.05, 5)]),  # a hole with an island
        (2, [[(-79, 44), (-78.5, 44), (-78.5, 44.5), (-79, 44.5), (-79, 44)], [(-78.9, 44.1), (-78.6, 44.1), (-78.6, 44.4), (-78.9, 44.4)]]),
        (3, [circle(-80.3, 44.6, 0.1, 7), circle(-78.2, 43.8, 0.15, 40)]),
        (4, [[(-80.5, 43.5), (-77.9, 43.9), (-80.45, 43.55)]]),  # a sliver across many cells
        (5, []),
        (6, [[(-80, 44), (-79.9, 44)]]),
    ]
    df = spark.createDataFrame([(k, [ring(r) for r in rings]) for k, rings in polys], RINGS)
    pick = np.random.default_rng(4)
    pts = pd.DataFrame({"lat": 43.4 + 1.5 * pick.random(3000), "lng": -80.6 + 2.8 * pick.random(3000)})
    edge = pd.DataFrame({"lat": [44.0, 44.5, 44.0, 44.25], "lng": [-79.0, -79.0, -78.5, -78.9]})  # on corners and sides
    pts = pd.concat([pts, edge], ignore_index=True)
    out = S.containing_polygons(spark.createDataFrame(pts), df, "rings", F.col("k"))
    got = {(r["l_lat"], r["l_lng"]): r["best"] for r in out.collect()}
    want = {}
    for k, rings in polys[:4]:
        for la, ln in pts[inside(pts.lng.to_numpy(), pts.lat.to_numpy(), rings)].itertuples(index=False):
            want[la, ln] = k
    assert got == want and len(set(got.values())) == 4
    assert S.containing_polygons(spark.createDataFrame(pts), df.where("k > 4"), "rings", F.col("k")).count() == 0


def test_a_ring_of_fifty_thousand_vertices(spark):
    shape = circle(-80, 44, 0.5, 50_000, wave=0.3)
    df = spark.createDataFrame([(7, [ring(shape), ring(circle(-80, 44, 0.1, 500))])], RINGS)
    whole, partial = S._ring_cells(df.withColumn("best", F.col("k")), "rings")
    held = partial.agg(F.sum(F.size("edges")).alias("all"), F.max(F.size("edges")).alias("most")).first()
    assert held["all"] < 3 * 50_500 and held["most"] < 1000  # no ring is copied from cell to cell
    pick = np.random.default_rng(5)
    pts = pd.DataFrame({"lat": 43.3 + 1.4 * pick.random(1500), "lng": -80.7 + 1.4 * pick.random(1500)})
    got = {(r["l_lat"], r["l_lng"]) for r in S.containing_polygons(spark.createDataFrame(pts), df, "rings", F.col("k")).collect()}
    hit = inside(pts.lng.to_numpy(), pts.lat.to_numpy(), [shape, circle(-80, 44, 0.1, 500)])
    assert got == set(pts[hit].itertuples(index=False, name=None)) and 200 < len(got) < 1300
