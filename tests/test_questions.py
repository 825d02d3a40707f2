"""Every named question runs on stored tables built from the smallest data set."""

import os

import pytest
from pyspark.sql import functions as F

from riffle.domain import Tables
from riffle.functions import geo
from riffle.operators.aggregates import benthic_samples, thermal_summary
from riffle.operators.tables import with_defaults
from riffle.plans.questions import Questions
from riffle.schemas import DEFAULTS, schema

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
HERE = dict(lat=44.0, lng=-79.5)


@pytest.fixture(scope="module")
def q(spark):
    t = Tables(spark, FOLDER)
    v = geo.wkt_vertices("geom_wkt")
    key = lambda p: geo.node_key(p["lng"], p["lat"])
    monthly = t.readings.groupBy("station_id", F.year("sampled_at").alias("year"), F.month("sampled_at").alias("month")).agg(
        F.max("station_name").alias("station_name"), F.max("lat").alias("lat"), F.max("lng").alias("lng"),
        F.avg("temp_c").alias("mean_temp_c"), F.max("temp_c").alias("max_temp_c"))
    frames = {
        "observations": t.observations, "gbif_observations": t.gbif, "water_quality_readings": t.readings,
        "stream_segments": t.segments.withColumns({"start_node": key(F.element_at(v, 1)), "end_node": key(F.element_at(v, -1))}),
        "barriers": t.barriers, "stocking_records": t.stocking, "water_features": t.water, "access_points": t.access,
        "bird_observations": t.birds, "benthic_samples": benthic_samples(t.taxa, t.visits),
        "geology_units": t.geology.withColumnsRenamed({"lat": "centroid_lat", "lng": "centroid_lng"}),
        "stream_temperature_summaries": thermal_summary(monthly),
        "species_ranges": t.ranges.withColumn("jurisdictions_present", F.array("jurisdiction")),
        "reddit_posts": t.documents.select(F.col("doc_id").cast("string").alias("post_id"), F.col("source").alias("title"),
                                           F.col("text").alias("body"), F.array(F.lit("walleye")).alias("extracted_species")),
        "regulation_chunks": t.documents.select((F.col("doc_id") % 20 + 1).alias("zone"), F.lit("CA-ON").alias("jurisdiction"),
                                                F.col("doc_id").alias("regulation_year"), F.col("text").alias("raw_text")),
        "sdm_predictions": t.predictions.withColumnsRenamed({"prob": "presence_probability", "lat": "centroid_lat", "lng": "centroid_lng"}),
        "behavioral_insights": t.insights.withColumns({"conclusion": F.lit("c"), "version": F.lit(1), "is_current": F.lit(True)}),
        "trips": t.trips.withColumnRenamed("trip_id", "id"), "dismissed_segments": t.dismissed,
        "recommendations": spark.createDataFrame([], schema("recommendations")),
        "stream_gauge_readings": t.gauges.withColumnsRenamed({"ts": "reading_datetime", "level_m": "water_level_m"}),
    }
    tables = {n: with_defaults(f, schema(n), DEFAULTS.get(n)) for n, f in frames.items()}
    from riffle.catalog.scores import features, untapped

    out = Questions(tables, features(t), untapped(t))
    out.t = t
    return out


def rows(df):
    return len(df.collect())


def test_observation_questions(q):
    assert rows(q.recent_observations(**HERE, asof="2001-06-30", radius_km=200, days_back=900, species="urgent")) > 0
    assert rows(q.gbif_summary(**HERE, radius_km=200, asof="2001-01-01", days_back=9000)) > 0
    assert rows(q.oldest_record(**HERE, species="urgent", radius_km=400)) == 1
    assert rows(q.search_posts("the", "walleye", limit=5)) == 5
    assert rows(q.behavioral_insights("view")) > 0


def test_record_questions(q, spark):
    new = spark.createDataFrame([(10**9, "view", "new", "confirmed", 0), (10**9 + 1, "view", " ", "confirmed", 0)],
                                "id bigint, species string, conclusion string, confidence string, replaces bigint")
    before = q.table("behavioral_insights").count()
    assert q.record_insight(new).count() == before + 1
    assert q.dismiss_segment(1, "2024-01-01", "seen").where("ogf_id = 1").count() == 1
    recs = q.tactical_recommendation(q.t.moments)
    log = q.record_recommendation(recs, "2024-01-01")
    assert log.count() == q.t.moments.count() and log.select("id").distinct().count() == log.count()


def test_water_questions(q):
    stations = q.t.supplier.select(F.col("s_suppkey").cast("string").alias("station_id"), F.lit(44.0).alias("lat"), F.lit(-79.5).alias("lng"))
    assert rows(q.stream_conditions(stations, **HERE)) == 3
    assert rows(q.nearby_water(**HERE, asof="2024-01-31", radius_km=400, not_in_trip_log=True)) > 0
    assert rows(q.access_points(**HERE, radius_km=400)) == 15
    hourly = q.t.gauges.select(F.col("station_id").alias("place_id"), "ts", "reading_id", F.col("level_m").alias("pressure"))
    assert rows(q.pressure_trend(hourly)) == hourly.select("place_id").distinct().count()


def test_rule_questions(q):
    assert rows(q.stocking_history(2002, species="brand")) == 10
    assert rows(q.stocking_events(name="red")) > 0
    assert rows(q.species_range("customer", **HERE)) == 1 and rows(q.sar_species()) > 0
    assert rows(q.regulations(zone=3)) == 1 and rows(q.regulations(**HERE, species="the")) == 1


def test_habitat_questions(q):
    stations, stats, judged = q.water_quality(**HERE, radius_km=300, date_from="1996-01-01")
    assert rows(stations) > 0 and rows(stats) > 3 and rows(judged) == 1
    sites, judged = q.benthic_habitat(**HERE, radius_km=300)
    assert rows(sites) > 0 and rows(judged) == 1
    assert rows(q.substrate(**HERE, radius_km=100)) == 1
    near, top = q.stream_temperature(**HERE, radius_km=300)
    assert rows(near) > 0 and rows(top) == 1
    per, all_, note = q.piscivore_activity(**HERE, asof="2024-01-31", radius_km=400)
    assert rows(per) > 0 and rows(all_) == 1 and rows(note) == 1


def test_network_and_score_questions(q):
    assert rows(q.connected_tributaries("red widget")) >= 0
    assert rows(q.species_predictions(**HERE, radius_km=300, species="Pumpkinseed")) == 1
    found = q.find_untapped_water(**HERE, radius_km=300, species="Lepomis gibbosus", limit=4)
    assert 0 < rows(found) <= 4
    got = q.find_exploration_targets(**HERE, radius_km=300, limit=3, previously_shown=[5])
    assert 0 < rows(got) <= 3 and "connectivity_note" in got.columns
    connected, text = q.analyze_watershed(**HERE, species="3-MEDIUM", radius_km=50)
    assert connected.count() >= 0 and text.count() <= 1
