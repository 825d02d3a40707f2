"""Species distribution models and the batch jobs built on them."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.catalog.tables import folder
from riffle.plans import sdm as M
from riffle.plans.model_store import ModelStore, train_and_save
from riffle.session import cut

TREES = 200
VERSION = "rf-20010101"
TARGET = "1-URGENT"


def matrix(t):
    return t.feats.select(
        "ogf_id", "centroid_lat", "centroid_lng", "stream_order", "length_m", "substrate_category",
        "thermal_regime", "ept_quality", "is_confluence_segment", "connected_to_waterbody",
        "distance_to_nearest_confluence_km", "nearest_waterbody_distance_m",
        (F.col("ogf_id") % 13 == 0).alias("is_stocked_within_5yr"))


def rows(t):
    return M.records(t.observations, t.gbif)


_SNAP = """usable AS (SELECT 'o' || observation_id AS rec, lower(species) AS sp, lat, lng FROM observations UNION ALL
      SELECT 'g' || gbif_key, lower(species), lat, lng FROM gbif WHERE coalesce(coordinate_uncertainty_m, 0) <= 5000),
    snap AS (SELECT rec, sp, ogf_id FROM (SELECT o.rec, o.sp, f.ogf_id,
        sqrt(power(o.lat - f.centroid_lat, 2) + power(o.lng - f.centroid_lng, 2)) AS d,
        row_number() OVER (PARTITION BY o.rec ORDER BY
          sqrt(power(o.lat - f.centroid_lat, 2) + power(o.lng - f.centroid_lng, 2)), f.ogf_id) AS rn
      FROM usable o JOIN feats f ON abs(o.lat - f.centroid_lat) <= 0.09
        AND abs(o.lng - f.centroid_lng) <= 0.09) WHERE rn = 1 AND d <= 0.09)"""
_PRESENT = "present AS (SELECT DISTINCT s.ogf_id, centroid_lat, centroid_lng FROM snap s JOIN feats USING (ogf_id) WHERE sp = 'household')"
_ORDER = "CAST(CAST('0x' || substr(md5(ogf_id || ':42'), 1, 13) AS BIGINT) AS DOUBLE)"


def _sampled(pool: str, reach: str, wanted: str) -> str:
    return f"""SELECT ogf_id FROM (SELECT ogf_id, row_number() OVER (ORDER BY {_ORDER}) AS rn FROM ({pool}) c
      WHERE NOT EXISTS (SELECT 1 FROM present p WHERE sqrt(power(c.centroid_lat - p.centroid_lat, 2)
        + power(c.centroid_lng - p.centroid_lng, 2)) <= {reach})) WHERE rn <= (SELECT {wanted} FROM present)"""


@query("l1_presence_set", f"WITH {_SNAP} SELECT DISTINCT ogf_id FROM snap WHERE sp = '1-urgent'")
def _(t):
    return M.presence(rows(t), matrix(t), TARGET)


@query("l2_target_group_absence", f"WITH {_SNAP}, {_PRESENT} " + _sampled("""
      SELECT DISTINCT s.ogf_id, centroid_lat, centroid_lng FROM snap s JOIN feats USING (ogf_id)
      WHERE s.ogf_id NOT IN (SELECT ogf_id FROM present)""", "10.0 / 111.0", "count(*) * 5"))
def _(t):
    m = matrix(t)
    present = cut(M.presence(rows(t), m, "HOUSEHOLD"))
    return M.target_group_absence(rows(t), m, present)


@query("l3_random_background", f"WITH {_SNAP}, {_PRESENT} " + _sampled("""
      SELECT ogf_id, centroid_lat, centroid_lng FROM feats WHERE ogf_id NOT IN (SELECT ogf_id FROM present)
      """, "0.045", "least(count(*) * 10, 10000)"))
def _(t):
    m = matrix(t)
    present = cut(M.presence(rows(t), m, "HOUSEHOLD"))
    return M.random_background(m, present)


def trained(t, species="HOUSEHOLD"):
    m = cut(matrix(t))
    r = rows(t)
    snapped = cut(M.snapped_records(r, m))
    present = cut(M.presence(r, m, species, snapped=snapped))
    return m, M.training_rows(m, present, M.target_group_absence(r, m, present, snapped=snapped))


_KINDS = ("substrate_category", "thermal_regime", "ept_quality")
_L4 = ", ".join(f"nullif({c}, 'unknown') AS {c}" for c in _KINDS)
_MODES = ", ".join(f"(SELECT {c} FROM base WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}_mode" for c in _KINDS)
_CODES = {c: f"(SELECT count(DISTINCT v) FROM (SELECT coalesce({c}, 'missing') AS v FROM base) x WHERE v < coalesce(b.{c}, 'missing'))" for c in _KINDS}


@query("l4_preprocessing", f"""
    WITH base AS (SELECT ogf_id, length_m, nearest_waterbody_distance_m AS w, {_L4} FROM feats),
    middle AS (SELECT quantile_cont(w, 0.5) AS med, {_MODES} FROM base),
    filled AS (SELECT ogf_id, length_m, coalesce(w, med) AS w FROM base, middle),
    spread AS (SELECT avg(length_m) AS ml, stddev_pop(length_m) AS sl, avg(w) AS mw, stddev_pop(w) AS sw FROM filled)
    SELECT b.ogf_id, round((f.length_m - ml) / sl, 6) AS length_score, round((f.w - mw) / sw, 6) AS waterbody_score, f.w AS waterbody_filled,
      {", ".join(f"coalesce(b.{c}, {c}_mode) AS {c}" for c in _KINDS)}, {", ".join(f"CAST({q} AS DOUBLE) AS {c}_code" for c, q in _CODES.items())}
    FROM base b JOIN filled f USING (ogf_id), middle, spread""")
def _(t):
    """Both variants on categories with missing values, saved, loaded and applied from disk."""
    train = M.prepared(matrix(t).withColumns({c: F.nullif(F.col(c), F.lit("unknown")) for c in _KINDS}))
    out = train
    for one_hot in (True, False):
        path = f"{folder(t, 'stages')}/{one_hot}"
        Pipeline(stages=M.preprocessing(train, one_hot)).fit(train).write().overwrite().save(path)
        made = PipelineModel.load(path).transform(train)
        kept = {"length_m_score": "length_score", "nearest_waterbody_distance_m_score": "waterbody_score", **{f"{c}_whole": f"{c}_w" for c in _KINDS}} if one_hot else {
            "nearest_waterbody_distance_m_filled": "waterbody_filled", **{f"{c}_code": f"{c}_c" for c in _KINDS}}
        out = out.join(made.select("ogf_id", *[F.col(a).alias(b) for a, b in kept.items()]), "ogf_id")
    return out.select("ogf_id", F.round("length_score", 6).alias("length_score"), F.round("waterbody_score", 6).alias("waterbody_score"), "waterbody_filled",
                      *[F.col(f"{c}_w").alias(c) for c in _KINDS], *[F.col(f"{c}_c").alias(f"{c}_code") for c in _KINDS])


@query("l5_weighted_forest")
def _(t):
    m, train = trained(t)
    model = M.fit(train, TREES)
    return M.score(model, m).select("ogf_id", F.round("probability", 6).alias("probability"))


@query("l6_isotonic_calibration")
def _(t):
    m, train = trained(t)
    return M.fit_calibrated(train, trees=TREES).score(m).select(
        "ogf_id", F.round("probability", 6).alias("probability"))


@query("l7_spatial_block_auc")
def _(t):
    _, train = trained(t)
    auc = M.spatial_cv_auc(train, TREES)
    return train.agg(F.count("*").alias("n_training"), F.sum("label").alias("n_presence")).withColumn(
        "auc", F.lit(float(auc)))


@query("l8_soft_label_model")
def _(t):
    m = cut(matrix(t))
    model, _ = M.train_soft(rows(t), m, TARGET, TREES)
    return M.score(model, m).select("ogf_id", F.round("probability", 6).alias("probability"))


@query("l9_feature_importance")
def _(t):
    _, train = trained(t)
    found = M.importances(M.fit(train, TREES))
    return t.spark.createDataFrame(found, "feature string, importance double")


@query("l10_train_species")
def _(t):
    """All species with enough presences are trained, calibrated and saved; a new object loads and scores."""
    m, where = cut(matrix(t)), folder(t, "species_models")
    train_and_save(ModelStore(t.spark, where), rows(t), m, None, VERSION, TREES)
    store = ModelStore(t.spark, where)
    return store.predict_all(m).join(store.latest().select("species", "n_presence"), "species").select(
        "ogf_id", "species", F.round("presence_probability", 6).alias("probability"), "n_presence", F.col("confidence_tier").alias("confidence"), "model_version")


@query("l11_top_two_models", """
    SELECT ogf_id, max(CASE WHEN rn = 1 THEN species END) AS top1, max(CASE WHEN rn = 2 THEN species END) AS top2
    FROM (SELECT ogf_id, species, row_number() OVER (PARTITION BY ogf_id ORDER BY coalesce(prob, 0) DESC,
      species) AS rn FROM predictions) WHERE rn <= 2 GROUP BY 1""")
def _(t):
    from riffle.operators.ranking import top_two

    return top_two(t.predictions.fillna(0.0, ["prob"]), "ogf_id", "species", "prob").select(
        "ogf_id", "top1", "top2")
