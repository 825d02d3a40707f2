"""Grid joins against brute force, on data where one spot holds a third of all points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.operators import joins as J
from riffle.operators import spatial as S


def cloud(n, seed):
    r = np.random.default_rng(seed)
    a = np.c_[42 + 4 * r.random(n), -83 + 7 * r.random(n)]
    third = n // 3
    a[:third] = [44.0, -80.0] + r.normal(0, 1e-3, (third, 2))
    a[third:third + n // 10] = [43.0, -79.0]
    return pd.DataFrame({"id": np.arange(n), "lat": a[:, 0], "lng": a[:, 1]})


@pytest.fixture(scope="module")
def sides(spark):
    l, r = cloud(400, 1), cloud(700, 2)
    return l, r, spark.createDataFrame(l), spark.createDataFrame(r)


def degrees(l, r):
    return np.hypot(l.lat.values[:, None] - r.lat.values, l.lng.values[:, None] - r.lng.values)


def great_circle(l, r):
    a, o, b, p = (np.radians(x) for x in (
        l.lat.values[:, None], l.lng.values[:, None], r.lat.values, r.lng.values))
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((p - o) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(h))


@pytest.mark.parametrize("limit", [250_000, 200])
def test_radius_count(sides, limit):
    l, r, dl, dr = sides
    out = S.with_radius_count(dl, dr, 0.225, S.DEGREES, pair_limit=limit).toPandas().sort_values("id")
    assert (out.n.values == (degrees(l, r) <= 0.225).sum(1)).all()


@pytest.mark.parametrize("limit", [250_000, 200])
def test_radius_sum_in_box(sides, limit):
    l, r, dl, dr = sides
    out = S.with_radius_sums(dl, dr, 0.1, S.box_metric(1.4), {"s": F.col("id")},
                             pair_limit=limit).toPandas().sort_values("id")
    near = (abs(l.lat.values[:, None] - r.lat.values) <= 0.1) & (
        abs(l.lng.values[:, None] - r.lng.values) / 1.4 <= 0.1)
    assert (out.s.values == (near * r.id.values).sum(1)).all()


@pytest.mark.parametrize("limit", [250_000, 200])
def test_nearest_bounded_takes_smallest_key_on_ties(sides, limit):
    l, r, dl, dr = sides
    out = S.with_nearest(dl, dr, S.DEGREES, "id", bound=0.1, pair_limit=limit).toPandas().sort_values("id")
    d = degrees(l, r)
    want = np.where(d.min(1) <= 0.1, d.argmin(1), -1)
    assert (out.near_id.fillna(-1).values == want).all()


def test_nearest_unbounded_reaches_outliers(spark, sides):
    l, r, dl, dr = sides
    far = pd.DataFrame({"id": [900, 901], "lat": [10.0, 80.0], "lng": [-10.0, 100.0]})
    both = pd.concat([l, far])
    out = S.with_nearest(dl.unionByName(spark.createDataFrame(far)), dr, S.KM_SCALED, "id",
                         pair_limit=500).toPandas().sort_values("id")
    want = np.hypot((both.lat.values[:, None] - r.lat.values) * 111,
                    (both.lng.values[:, None] - r.lng.values) * 80.5).min(1)
    assert np.allclose(out.distance.values, want)


def test_nearest_great_circle(sides):
    l, r, dl, dr = sides
    out = S.with_nearest(dl, dr, S.HAVERSINE, "id", bound=8.0, pair_limit=500).toPandas().sort_values("id")
    d = great_circle(l, r).min(1)
    assert np.allclose(out.distance.fillna(-1).values, np.where(d <= 8, d, -1))


def test_nearest_without_right_rows(sides):
    _, _, dl, dr = sides
    assert S.nearest(dl, dr.limit(0), S.DEGREES, "id").count() == 0
    assert S.with_radius_count(dl, dr.limit(0), 1.0, S.DEGREES).agg(F.sum("n")).first()[0] == 0


def test_null_coordinates_stay_unmatched(spark):
    l = spark.createDataFrame([(1, 44.0, -80.0), (2, None, -80.0)], "id int, lat double, lng double")
    out = {r["id"]: r["near_id"] for r in S.with_nearest(l, l, S.DEGREES, "id").collect()}
    assert out == {1: 1, 2: None}


def test_nearest_line(spark):
    r = np.random.default_rng(5)
    lines = [(i, [tuple(p) for p in np.c_[-80 + r.random(3), 44 + r.random(3)]]) for i in range(40)]
    df = spark.createDataFrame(
        [(i, [{"lng": float(x), "lat": float(y)} for x, y in v]) for i, v in lines],
        "k int, v array<struct<lng:double,lat:double>>")
    pts = pd.DataFrame({"id": range(60), "lat": 44 + r.random(60), "lng": -80 + r.random(60)})
    found = S.nearest_line(spark.createDataFrame(pts), df, 0.03, "k", "v", piece_deg=0.05, pair_limit=50)
    got = {(x["l_lat"], x["l_lng"]): x["k"] for x in found.collect()}

    def dist(p, a, b):
        a, b, p = map(np.array, (a, b, p))
        t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
        return np.hypot(*(p - (a + t * (b - a))))

    for _, row in pts.iterrows():
        best = min((min(dist((row.lng, row.lat), v[j], v[j + 1]) for j in range(2)), i) for i, v in lines)
        assert got.get((row.lat, row.lng)) == (best[1] if best[0] <= 0.03 else None)


def test_polygons_against_ray_cast(spark):
    r = np.random.default_rng(6)
    polys = []
    for i in range(12):
        ang = np.sort(r.random(9)) * 2 * np.pi
        rad = 0.02 + r.random(9) * (0.5 if i % 2 else 0.05)
        c = (-80 + r.random(), 44 + r.random())
        ring = [(c[0] + d * np.cos(a), c[1] + d * np.sin(a)) for a, d in zip(ang, rad)]
        polys.append((i, ring + ring[:1]))
    df = spark.createDataFrame(
        [(i, [{"lng": float(x), "lat": float(y)} for x, y in v]) for i, v in polys],
        "k int, ring array<struct<lng:double,lat:double>>")
    pts = pd.DataFrame({"lat": 43.8 + 1.5 * r.random(500), "lng": -80.2 + 1.5 * r.random(500)})
    out = S.containing_polygons(spark.createDataFrame(pts), df, "ring", F.col("k"))
    got = {(x["l_lat"], x["l_lng"]): x["best"] for x in out.collect()}

    def inside(x, y, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    for _, p in pts.iterrows():
        want = [i for i, ring in polys if inside(p.lng, p.lat, ring)]
        assert got.get((p.lat, p.lng)) == (max(want) if want else None)


def test_thinning_is_greedy_best_first(spark):
    pts = cloud(300, 9).assign(q=lambda d: d.id % 2, v=lambda d: (d.id * 37) % 101)
    out = S.thin_by_distance(spark.createDataFrame(pts), 8, 40.0, ["q"], [F.desc("v"), F.col("id")], "id")
    got = {q: [r["id"] for r in sorted(out.where(F.col("q") == q).collect(), key=lambda r: r["rank"])]
           for q in (0, 1)}
    for q in (0, 1):
        kept = []
        for _, p in pts[pts.q == q].sort_values(["v", "id"], ascending=[False, True]).head(160).iterrows():
            d = great_circle(pd.DataFrame([p]), pd.DataFrame(kept))[0] if kept else np.array([])
            if not (d < 40.0).any():
                kept.append(p)
            if len(kept) == 8:
                break
        assert got[q] == [int(p.id) for p in kept]


def test_thinning_looks_past_a_crowd_of_best_rows(spark):
    crowd = [(i, 1000 - i, 45.0 + i * 1e-5, -75.0) for i in range(90)]
    away = [(100 + i, 5 - i, 46.0 + i, -75.0) for i in range(4)]
    df = spark.createDataFrame(crowd + away, "id long, v int, lat double, lng double")
    out = S.thin_by_distance(df, 3, 1.0, [], [F.desc("v")], "id")
    assert [r["id"] for r in out.orderBy("rank").collect()] == [0, 100, 101] and out.columns == [*df.columns, "rank"]
    both = df.withColumn("q", F.explode(F.array(F.lit("a"), F.lit("b")))).where("q = 'a' OR id < 90")
    got = {(r["q"], r["id"]) for r in S.thin_by_distance(both, 3, 1.0, ["q"], [F.desc("v")], "id").collect()}
    assert got == {("a", 0), ("a", 100), ("a", 101), ("b", 0)}
    assert S.thin_by_distance(df.limit(0), 3, 1.0, [], [F.desc("v")], "id").count() == 0


def test_soft_labels_conserve_weight(spark):
    seg = spark.createDataFrame(cloud(200, 3).rename(columns={"id": "ogf_id"}))
    occ = spark.createDataFrame(cloud(90, 4).assign(is_obscured=True))
    total = J.soft_labels(occ, seg).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(90)


def test_name_overlap(spark):
    items = spark.createDataFrame([(1, "Mill Pond"), (2, "Lake"), (3, None), (4, "Far Bay")], "i int, n string")
    seen = spark.createDataFrame([("old mill pond, north",), ("big lake",)], "v string")
    left = J.without_name_overlap(items, "n", seen, "v").collect()
    assert sorted(r["i"] for r in left) == [3, 4]


def test_nearest_in_box(spark):
    few = spark.createDataFrame([(1, 44.0, -80.0)], "q int, lat double, lng double")
    pts = spark.createDataFrame([(1, 44.02, -80.0), (2, 44.0, -80.015), (3, 44.0, -80.0185)],
                                "k int, lat double, lng double")
    got = J.nearest_in_box(few, pts, 2 / 111, "q", "k", []).first()
    assert got["k"] == 2
    assert J.in_box_of(few, pts, 2 / 111, "q", ["k"]).count() == 1


def test_midpoint_and_area(spark):
    row = spark.sql("SELECT 'LINESTRING (-80 44, -80 44.3, -79.9 44.3)' AS w").select(
        geo.polyline_midpoint(geo.wkt_vertices("w")).alias("m"),
        geo.polyline_midpoint(geo.wkt_vertices(F.lit("POINT (-80.5 44.5)"))).alias("p")).first()
    assert (row["m"]["lng"], row["m"]["lat"]) == pytest.approx((-80, 44.2))
    assert (row["p"]["lng"], row["p"]["lat"]) == (-80.5, 44.5)
