"""Parsers on small files with the known traps; scores, rules, models and streams."""

import json

import pytest
from pyspark.sql import functions as F

from riffle.operators import joins as J
from riffle.plans import gauges as Ga
from riffle.plans import scores as Sc
from riffle.plans import sdm as M
from riffle.plans import tactical as Ta
from riffle.plans.jobs import Store
from riffle.sources import delimited as D
from riffle.sources import json_documents as Js
from riffle.sources import kml as K
from riffle.sources import osm as O
from riffle.sources import polygons as Pg
from riffle.streaming import gauges as Sg


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_stocking_csv(spark, tmp_path):
    p = write(tmp_path / "s.csv", "Stocking_Year,Species,Official_Waterbody_Name,Unoffcial_Waterbody_Name,"
              "Number_of_Fish_Stocked,Latitude,Longitude,ObjectId,Developmental_Stage\n"
              "2020,RAINBOW TROUT, Mill Pond ,,100,44.1,-80.2,1,Yearling\n"
              "2019,brook trout,,Back Lake,,,,2,\n2019,walleye,,,5,,,3,\n,walleye,A,,5,,,4,\n"
              "2019,,A,,5,,,5,\n2019,pike,A,,x,,,6,\n", "utf-8-sig")
    good, bad = D.stocking(D.read_text_columns(spark, p))
    rows = {r["record_id"]: r for r in good.collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["species"] == "Rainbow Trout" and rows["1"]["waterbody_name"] == "Mill Pond"
    assert rows["2"]["waterbody_name"] == "Back Lake" and rows["2"]["lat"] is None
    assert {r["record_id"]: r["_reject_reason"] for r in bad.collect()} == {
        "3": "no waterbody name", "4": "bad year", "5": "no species", "6": "bad number"}


def test_observation_document(spark, tmp_path):
    doc = {"results": [
        {"id": 1, "taxon": {"id": 9, "name": "Esox lucius"}, "location": "43.5,-80.1", "observed_on": "2024-05-01",
         "geoprivacy": "obscured", "photos": [{"url": "u"}], "user": {"login": "me"}},
        {"id": 2, "location": "43.5,-80.1", "observed_on": "2024-05-01", "photos": []}, {"id": 3, "taxon": None}]}
    got = Js.observations(Js.read(spark, write(tmp_path / "o.json", json.dumps(doc)), Js.OBSERVATIONS)).collect()
    assert [r["observation_id"] for r in got] == [1, 2]
    assert got[0]["obscuration_radius_km"] == 22.0 and got[0]["jurisdiction"] == "CA-ON" and got[0]["photo_url"] == "u"
    assert got[1]["species"] == "Unknown" and got[1]["geoprivacy"] == "open" and got[1]["photo_url"] is None


def test_closed_way_has_area(spark, tmp_path):
    ring = [{"lat": 44.0, "lon": -80.0}, {"lat": 44.0, "lon": -79.99}, {"lat": 44.01, "lon": -79.99}, {"lat": 44.0, "lon": -80.0}]
    doc = {"elements": [
        {"type": "way", "id": 1, "tags": {"natural": "water", "water": "pond"}, "geometry": ring},
        {"type": "way", "id": 2, "tags": {"waterway": "stream"}, "geometry": ring[:2]},
        {"type": "node", "id": 3, "lat": 44.0, "lon": -80.0, "tags": {"shop": "x"}}]}
    got = {r["osm_id"]: r for r in O.water_features(Js.read(spark, write(tmp_path / "e.json", json.dumps(doc)), O.ELEMENTS)).collect()}
    assert got["way/1"]["feature_type"] == "pond" and got["way/1"]["area_m2"] > 0
    assert got["way/2"]["area_m2"] is None and len(got) == 2


def test_geology_placemarks(spark, tmp_path):
    write(tmp_path / "t1.kml", "<kml><Document>"
          "<Placemark><name>6a  Sand plain</name><description><![CDATA[<b>sand</b>]]></description><MultiGeometry>"
          "<Point><coordinates>-80,44,0</coordinates></Point><Polygon><outerBoundaryIs><LinearRing><coordinates>"
          "-81,43,0 -79,45,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>"
          "<Placemark><name>21 Fill</name><Point><coordinates>-80,44</coordinates></Point></Placemark>"
          "<Placemark><name>99</name><Polygon><outerBoundaryIs><LinearRing><coordinates>-80,44 -78,46</coordinates>"
          "</LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    got = {r["unit_id"]: r for r in K.geology_units(K.read_placemarks(spark, str(tmp_path / "t1.kml"))).collect()}
    assert set(got) == {"t1_0000", "t1_0001"}
    a, b = got["t1_0000"], got["t1_0001"]
    assert (a["substrate_class"], a["primary_material"], a["centroid_lat"], a["bbox_minx"]) == ("coarse", "sand", 44, -81)
    assert (b["substrate_class"], b["unit_name"], b["centroid_lng"]) == ("mixed", "99", -79)


def test_watercourses_far_from_home_become_points(spark, tmp_path):
    f = lambda i, y: {"attributes": {"OGF_ID": i, "FLOW_DIRECTION_VERIFIED_IND": "Yes"},
                      "geometry": {"paths": [[[-80.0, y], [-80.0, y + 0.1]]]}}
    doc = {"features": [f(1, 44.0), f(2, 47.0), {"attributes": {"OGF_ID": 3}, "geometry": {"paths": [[[0, 0]]]}}]}
    got = {r["ogf_id"]: r for r in Js.stream_segments(
        Js.read(spark, write(tmp_path / "w.json", json.dumps(doc)), Js.WATERCOURSES), (44.0, -80.0)).collect()}
    assert set(got) == {1, 2} and got[1]["geom_wkt"].startswith("LINESTRING") and got[2]["geom_wkt"].startswith("POINT")
    assert got[1]["start_node"] == "-80.0,44.0" and got[1]["watercourse_type"] == "Stream"


def test_park_type_wording(spark):
    raw = ["provincial wilderness class", "NATURERESERVE", "odd thing"]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    assert [r[0] for r in df.select(Pg.park_type(F.col("t"))).collect()] == ["Wilderness", "Nature Reserve", "Odd Thing"]


def test_scores_by_hand(spark):
    row = spark.createDataFrame(
        [(True, 0.1, True, 0, 0.8, 0.25, 0.5)], "is_confluence_segment boolean, distance_to_nearest_confluence_km double, "
        "connected_to_waterbody boolean, observation_density_25km bigint, habitat_score double, observation_pressure double, "
        "access_score double").select(Sc.structural_bonus(), *[Sc.mode_score(m) for m in ("balanced", "easy_access", "adventure")]).first()
    assert list(row) == pytest.approx([1.7, 0.6 * 1.7 * 1.5, 0.3 * 1.7 * 1.5, 0.6 * 0.6 * 1.7 * 1.5])


def test_condition_labels(spark):
    lab = lambda c, t: spark.range(1).select(Ga.condition(F.lit(c), F.lit(t).cast("string"))).first()[0]
    assert lab("elevated", "rising") == "elevated and rising"
    assert lab("low", None) == "normal and stable" and lab("normal", "falling") == "normal and falling"
    name = spark.range(1).select(Ga.river_name(F.lit("GRAND RIVER NEAR MILL AT GALT"))).first()[0]
    assert name == "Grand River Near Mill"


def test_tactical_rules(spark):
    rows = spark.createDataFrame(
        [("Smallmouth Bass", 7, 22.0, "murky", "falling", "dawn"), ("rainbow darter", 1, None, None, None, None)],
        "species string, month int, temp_c double, clarity string, pressure string, time_of_day string")
    got = Ta.recommend(rows).collect()
    bass = {r["choice"]: r for r in got if r["group"] == "bass"}
    assert bass[1]["lure_type"].startswith("topwater") and bass[1]["retrieve_speed"] == "fast"
    assert bass[1]["confidence"] == "high" and bass[2]["confidence"] == "medium"
    assert "add scent if available" in bass[1]["technique"] and bass[2]["technique"].endswith("(alternative)")
    assert [r["lure_type"] for r in got if r["group"] == "microfishing"] == ["ultralight rig"]


def test_distance_wording(spark):
    t = lambda km: spark.range(1).select(J.distance_text(F.lit(km))).first()[0]
    assert (t(0.3504), t(1.24)) == ("350m", "1.2km")


def test_exact_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "ogf_id")
    one, two = (sorted(r[0] for r in M.sample_exact(rows, "ogf_id", 321).collect()) for _ in range(2))
    assert len(one) == 321 and one == two
    assert M.sample_exact(rows, "ogf_id", 9000).count() == 5000


def test_forest_learns_and_importances_sum_to_one(spark):
    x = spark.range(400).select(
        F.col("id").alias("ogf_id"), (F.col("id") % 6).cast("double").alias("stream_order"),
        (F.col("id") % 5).cast("double").alias("length_m"), F.lit("coarse").alias("substrate_category"),
        (43 + F.col("id") % 20 / 10).alias("centroid_lat"), (-80 + F.col("id") % 17 / 10).alias("centroid_lng"))
    train = M.training_rows(x, x.where("stream_order >= 3").select("ogf_id"),
                            x.where("stream_order < 3").select("ogf_id"))
    model = M.fit(train, trees=10)
    imp = M.importances(model)
    assert sum(v for _, v in imp) == pytest.approx(1.0) and imp[0][0] == "stream_order"
    p = M.score(model, x).join(x, "ogf_id").groupBy((F.col("stream_order") >= 3).alias("hi")).agg(F.avg("probability").alias("p"))
    got = {r["hi"]: r["p"] for r in p.collect()}
    assert got[True] > 0.8 > 0.2 > got[False]
    assert M.spatial_cv_auc(train, trees=5) > 0.9


STREAM = "station_id bigint, reading_id bigint, ts timestamp, level_m double, discharge_cms double"


def batch(spark, path, rows):
    spark.createDataFrame(rows, "station_id long, reading_id long, t string, level_m double, discharge_cms double").select(
        "station_id", "reading_id", F.to_timestamp("t").alias("ts"), "level_m", "discharge_cms").coalesce(1).write.mode(
        "append").parquet(path)


def test_stream_drops_copies_and_late_rows(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    go = lambda: Sg.run_available(Sg.deduplicated(Sg.read_stream(spark, src, STREAM)), out, chk)
    batch(spark, src, [(1, 1, "2024-01-10 00:00:00", 1.0, 1.0), (1, 2, "2024-01-10 00:00:00", 9.0, 9.0)])
    go()
    batch(spark, src, [(1, 3, "2024-01-20 00:00:00", 1.0, 1.0)])
    go()
    batch(spark, src, [(1, 4, "2024-01-11 00:00:00", 1.0, 1.0), (1, 5, "2024-01-19 00:00:00", 1.0, 1.0)])
    go()
    ids = sorted(r["reading_id"] for r in spark.read.parquet(out).collect())
    assert len(ids) == 3 and ids[0] in (1, 2) and ids[1:] == [3, 5]


def test_stream_state_matches_one_batch(spark, tmp_path):
    rows = [(1, i, f"2024-01-0{1 + i // 12} {i % 12 * 2:02d}:00:00", float(i % 5), float(i % 7) + 1) for i in range(36)]
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for part in (rows[:10], rows[10:25], rows[25:]):
        batch(spark, src, part)
        Sg.run_available(Sg.with_trends(Sg.read_stream(spark, src, STREAM)), out, chk)
    got = {r["reading_id"]: r for r in spark.read.parquet(out).collect()}
    want = {r["reading_id"]: r for r in Ga.labelled(spark.read.schema(STREAM).parquet(src)).collect()}
    assert len(got) == 36
    for k, w in want.items():
        assert got[k]["ref_level_m"] == w["ref_level_m"]
        assert got[k]["discharge_mean"] == pytest.approx(w["discharge_mean"])


def test_store_keeps_a_readable_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "ogf_id bigint, reason string")
    assert s.read("dismissed_segments").count() == 0
    assert s.merge("dismissed_segments", rows, F.lit(1)) == 2
    s.merge("dismissed_segments", rows.where("ogf_id = 2"), F.lit(1))
    assert s.read("dismissed_segments").count() == 2 and s.versions("dismissed_segments") == [1, 2]


def test_stream_labels_do_not_depend_on_arrival(spark, tmp_path):
    import pandas as pd

    from riffle.operators.windows import closest_in_time, trailing_means

    stamps = ["2024-01-08 09:00", "2024-01-10 12:00", "2024-01-08 12:00", "2024-01-08 12:00", "2024-01-09 13:00", "2024-01-11 00:00"]
    rows = [(1, i, pd.Timestamp(x).to_pydatetime(), float(i + 1), None if i % 2 else 2.0 * i) for i, x in enumerate(stamps)]
    shape = "station_id bigint, reading_id bigint, ts timestamp, level_m double, discharge_cms double"
    for r in rows:
        spark.createDataFrame([r], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = Sg.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, shape).schema, files_per_batch=1)
    Sg.run_available(Sg.with_trends(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    sent = spark.read.parquet(f"{tmp_path}/out")
    cols = ["reading_id", "ref_level_m", "ref_discharge_cms", "level_mean", "discharge_mean"]
    batch = trailing_means(closest_in_time(spark.createDataFrame(rows, shape), "station_id", "ts", "reading_id", 3 * 3600, ["level_m", "discharge_cms"], "ref_"),
                           "station_id", "ts", {"level_mean": "level_m", "discharge_mean": "discharge_cms"})
    assert sorted(map(tuple, Sg.settled(sent).select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert sent.count() > len(rows)
