"""Savable preprocessing, stored models, and the exact sample."""

import datetime
import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riffle.plans import jobs as J
from riffle.plans import sdm as M
from riffle.plans.fills import Median, MostFrequent, NumberFill, StandardScores, TextFill
from riffle.plans.model_store import ModelStore, slug, version_of


def test_fills_and_scores_survive_saving(spark, tmp_path):
    rows = [(1, 1.0, "b"), (2, None, None), (3, 4.0, "a"), (4, float("nan"), "b"), (5, 2.0, "a"), (6, 5.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, k string")
    stages = [Median(inputCols=["x"], outputCols=["f"]), StandardScores(inputCols=["f"], outputCols=["s"]), MostFrequent(inputCols=["k"], outputCols=["w"])]
    Pipeline(stages=stages).fit(df).write().overwrite().save(f"{tmp_path}/m")
    got = PipelineModel.load(f"{tmp_path}/m").transform(df).orderBy("id").collect()
    assert [r.f for r in got] == [1.0, 3.0, 4.0, 3.0, 2.0, 5.0]  # the median of 1, 2, 4, 5
    assert [r.w for r in got] == ["b", "a", "a", "b", "a", "a"]  # a and b are as frequent: the smaller
    mean = 3.0
    spread = (sum((v - mean) ** 2 for v in (1, 3, 4, 3, 2, 5)) / 6) ** 0.5
    assert [round(r.s, 9) for r in got] == [round((v - mean) / spread, 9) for v in (1, 3, 4, 3, 2, 5)]


def test_fills_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, k string")
    assert isinstance(Median(inputCols=["x"], outputCols=["f"]).fit(df), NumberFill)
    model = MostFrequent(inputCols=["k"], outputCols=["w"]).fit(df)
    assert isinstance(model, TextFill) and [r.w for r in model.transform(df).collect()] == ["missing", "missing"]
    assert Median(inputCols=["x"], outputCols=["f"]).fit(df.limit(0)).transform(df).first().f == 0.0


def test_medians_of_many_rows(spark):
    for n in (1, 2, 999, 1000):
        df = spark.range(n).selectExpr("CAST(id * id AS DOUBLE) AS x", "IF(id % 3 = 0, CAST(-id AS DOUBLE), NULL) AS y")
        got = Median(inputCols=["x", "y"], outputCols=["a", "b"]).fit(df).getOrDefault("values")
        assert got == [statistics.median(i * i for i in range(n)), statistics.median(-i for i in range(0, n, 3))]


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, 44 + i % 20 / 50, -79 - i // 20 / 50, i % 7, 100.0 + i, ["coarse", "fine", None][i % 3], float(i % 7 > 3)) for i in range(400)]
    train = M.prepared(spark.createDataFrame(rows, "ogf_id long, centroid_lat double, centroid_lng double, stream_order int, length_m double, substrate_category string, label double"))
    return train.withColumn("weight", F.lit(1.0)).cache()


def test_models_are_scored_from_disk(spark, trained, tmp_path):
    store = ModelStore(spark, f"{tmp_path}/store")
    assert store.list_trained_species() == [] and store.load("Esox lucius") is None and store.predict("Esox lucius", trained) is None
    assert store.predict_all(trained).count() == 0
    plain, whole = M.fit(trained, trees=5), M.fit_calibrated(trained, trees=5)
    meta = {"n_presence": 60, "n_absence": 9, "n_training": 400, "auc": 0.9, "trees": 5, "importances": M.importances(plain)}
    early = datetime.datetime(2001, 1, 1)
    store.save("Perca flavescens", plain, meta, "rf-1", early)
    store.save("Esox lucius", whole, {**meta, "n_presence": 20}, "rf-1", early)
    store.save("Esox lucius", plain, {**meta, "n_presence": 5}, "rf-2", early + datetime.timedelta(1))
    again = ModelStore(spark, f"{tmp_path}/store")
    assert again.list_trained_species() == ["Esox lucius", "Perca flavescens"]
    values = lambda df, c: {r["ogf_id"]: r[c] for r in df.collect()}
    assert values(again.predict("Perca flavescens", trained), "presence_probability") == values(M.score(plain, trained), "probability")
    assert values(again.predict("Esox lucius", trained, "rf-1"), "presence_probability") == pytest.approx(values(whole.score(trained), "probability"))
    newest = again.predict("Esox lucius", trained).first()
    assert (newest.model_version, newest.confidence_tier) == ("rf-2", "low") and again.load_metadata("Esox lucius", "rf-1").confidence_tier == "medium"
    row = again.load_metadata("Perca flavescens")
    assert row.confidence_tier == "high" and sum(row.importances.values()) == pytest.approx(1) and row.n_absence == 9
    assert again.load_metadata("Perca flavescens", "rf-9") is None and again.predict_all(trained).count() == 800


def test_a_model_without_its_row_is_not_listed(spark, trained, tmp_path):
    M.fit(trained, trees=2).write().save(f"{tmp_path}/models/ghost/rf-1/x/0/forest")
    assert ModelStore(spark, str(tmp_path)).list_trained_species() == []


def test_names():
    assert slug("4-NOT SPECIFIED") == "4_not_specified" and version_of(datetime.date(2026, 5, 1)) == "rf-20260501"


def test_sample_takes_a_scalar_subquery(spark):
    rows = spark.range(1000).withColumnRenamed("id", "ogf_id")
    assert M.sample_exact(rows, "ogf_id", rows.where("ogf_id < 7").agg(F.count("*") * 5).scalar()).count() == 35


@pytest.fixture(scope="module")
def recorded(spark):
    matrix = spark.range(240).selectExpr("id AS ogf_id", "44 + (id % 20) / 4 AS centroid_lat", "-79 - CAST(id / 20 AS INT) / 4 AS centroid_lng",
                                         "CAST(id % 7 AS INT) AS stream_order", "100.0 + id AS length_m", "false AS is_stocked_within_5yr")
    names = F.element_at(F.array(*map(F.lit, ["Esox lucius", "esox lucius", "Perca flavescens"])), F.col("k") % 3 + 1)
    rows = matrix.where("ogf_id % 4 = 0 OR ogf_id < 3").withColumn("k", F.col("ogf_id").cast("int")).select(
        F.when(F.col("ogf_id") < 3, "Rare one").otherwise(names).alias("species"), F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    return rows, matrix


def test_species_to_train_come_from_the_records(spark):
    snapped = spark.createDataFrame([("B b", i) for i in range(5)] + [("A", i % 4) for i in range(9)] + [(None, i) for i in range(9)]
                                    + [("c", 1), ("c", 2), ("C", 2), ("C", 3), ("C", 4), ("C", 5)], "species string, ogf_id long")
    assert M.trainable_species(snapped) == ["B b", "C"] and M.trainable_species(snapped, 4) == ["A", "B b", "C"]
    assert M.trainable_species(snapped.limit(0)) == []


def test_all_species_are_trained_and_their_scores_stored(spark, recorded, tmp_path):
    rows, matrix = recorded
    store, models = J.Store(spark, f"{tmp_path}/tables"), ModelStore(spark, f"{tmp_path}/models")
    names = J.train_and_store(store, models, rows, matrix, "rf-1", trees=3)
    assert names == ["Esox lucius", "Perca flavescens"] == models.list_trained_species()
    got = store.read("sdm_predictions").groupBy("species").agg(F.count("*").alias("n"), F.max("model_version").alias("v")).orderBy("species").collect()
    assert [tuple(r) for r in got] == [("Esox lucius", 240, "rf-1"), ("Perca flavescens", 240, "rf-1")]
    row = models.load_metadata("Esox lucius")
    assert (row.parts, row.calibrated, row.trees, row.n_presence) == (3, True, 3, 39)
