"""Species distribution models on Spark ML: presence data, background, training, scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions.predicates import at_most, real_coordinates
from riffle.operators import spatial as S
from riffle.operators.aggregates import BASS_POOL, values_at
from riffle.operators.joins import soft_labels
from riffle.plans.fills import Median, MostFrequent, StandardScores, TextFill
from riffle.session import cut

# Feature names, species with stocking as a confound, species trained.
CATEGORICAL = ["substrate_category", "thermal_regime", "ept_quality"]
NUMERIC = [
    "stream_order", "length_m", "flow_verified", "summer_mean_temp_c", "do_median_mgl", "ph_median",
    "conductivity_median_us_cm", "ept_proportion", "barrier_count_upstream",
    "distance_to_nearest_observation_km", "observation_density_25km", "is_stocked_within_5yr",
    "pwqmn_coverage", "is_confluence_segment", "distance_to_nearest_confluence_km",
    "nearest_waterbody_distance_m", "connected_to_waterbody",
]
STOCKING_CONFOUND = [
    "Oncorhynchus mykiss", "Salvelinus fontinalis", "Salmo trutta", "Oncorhynchus tshawytscha",
    "Oncorhynchus kisutch", "Salvelinus namaycush",
]
SPECIES_TO_TRAIN = [
    "Semotilus atromaculatus", "Lepomis gibbosus", "Perca flavescens", "Ameiurus nebulosus",
    "Catostomus commersonii", "Culaea inconstans", "Etheostoma caeruleum", "Ambloplites rupestris",
    "Micropterus nigricans",
]
SNAP_DEG = 0.09
TARGET_GROUP_KM = 10.0
TARGET_GROUP_RATIO = 5
BACKGROUND_DEG = 0.045
BACKGROUND_RATIO = 10
BACKGROUND_CAP = 10_000
MAX_UNCERTAINTY_M = 5000
MIN_PRESENCES = 5
SEED = 42
AT = ("centroid_lat", "centroid_lng")


def records(inat: DataFrame, gbif: DataFrame) -> DataFrame:
    """Usable occurrences of both sources: species, lat, lng, is_obscured."""
    a = inat.select("species", "lat", "lng", F.coalesce("is_obscured", F.lit(False)).alias(
        "is_obscured"))
    b = gbif.where(at_most("coordinate_uncertainty_m", MAX_UNCERTAINTY_M)).select(
        "species", "lat", "lng", F.lit(False).alias("is_obscured"))
    return a.unionByName(b).where(real_coordinates())


def of_species(rows: DataFrame, species: str) -> DataFrame:
    names = [n.lower() for n in (BASS_POOL if species in BASS_POOL else [species])]
    return rows.where(F.lower("species").isin(names))


def snapped_segments(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Distinct segments that occurrences snap to."""
    return S.nearest(rows, matrix, S.DEGREES, "ogf_id", bound=SNAP_DEG, right_at=AT).select(
        "ogf_id").distinct()


def snapped_records(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """(species, ogf_id) of all occurrences that snap, once each: training many species snaps them all at once."""
    found = S.with_nearest(rows.select("species", "lat", "lng"), matrix, S.DEGREES, "ogf_id", bound=SNAP_DEG, right_at=AT, how="inner")
    return found.select("species", F.col("near_ogf_id").alias("ogf_id")).distinct()


def trainable_species(snapped: DataFrame, least: int = MIN_PRESENCES) -> list[str]:
    """Species with at least ``least`` segments, in order; names that differ by case are one species, under the least
    name. What comes to the driver is one name for each model that is to be trained."""
    found = snapped.where("species IS NOT NULL").groupBy(F.lower("species").alias("_key")).agg(
        F.min("species").alias("species"), F.countDistinct("ogf_id").alias("n"))
    return [r["species"] for r in found.where(F.col("n") >= least).select("species").orderBy("species").collect()]


def presence(rows: DataFrame, matrix: DataFrame, species: str,
             stocking_exclusion: bool = True, snapped: DataFrame | None = None) -> DataFrame:
    """Segments with the species; stocked ones are left out for stocked salmonids."""
    if snapped is None:
        out = snapped_segments(of_species(rows, species), matrix)
    else:
        out = of_species(snapped, species).select("ogf_id").distinct()
    if stocking_exclusion and species in STOCKING_CONFOUND:
        stocked = matrix.where("is_stocked_within_5yr").select("ogf_id")
        out = out.join(stocked, "ogf_id", "left_anti")
    return out


def sample_exact(rows: DataFrame, key: str, wanted, seed: int = SEED) -> DataFrame:
    """The ``wanted`` rows with the smallest seeded hash, found by threshold instead of a sort.

    ``wanted`` may be a scalar subquery column; fewer rows than wanted are all kept.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")  # 52 bits
    hashed = cut(rows.withColumn("_h", h).withColumn("_g", F.lit(1)))
    w = F.lit(wanted) if isinstance(wanted, int) else wanted
    last = values_at(hashed, ["_g"], "_h", {"cut": F.least(F.col("n"), w) - 1})
    limit = last.select("v").scalar()
    return hashed.where(F.col("_h") <= limit).drop("_h", "_g")


def target_group_absence(rows: DataFrame, matrix: DataFrame, present: DataFrame,
                         ratio: int = TARGET_GROUP_RATIO, snapped: DataFrame | None = None) -> DataFrame:
    """Segments where other species were recorded, at least 10 km (in degrees) from presences."""
    anywhere = snapped_segments(rows, matrix) if snapped is None else snapped.select("ogf_id").distinct()
    anywhere = anywhere.join(present, "ogf_id", "left_anti")
    spots = matrix.select("ogf_id", *AT)
    near = S.with_radius_count(
        spots.join(anywhere, "ogf_id", "left_semi"), spots.join(present, "ogf_id", "left_semi"),
        TARGET_GROUP_KM / geo.KM_PER_DEGREE, S.DEGREES, "_near", left_at=AT, right_at=AT)
    eligible = near.where("_near = 0").select("ogf_id")
    return sample_exact(eligible, "ogf_id", present.agg(F.count("*") * ratio).scalar())


def random_background(matrix: DataFrame, present: DataFrame, ratio: int = BACKGROUND_RATIO,
                      cap: int = BACKGROUND_CAP) -> DataFrame:
    """Segments away from presences, as many as the method asks for."""
    spots = matrix.select("ogf_id", *AT)
    near = S.with_radius_count(
        spots.join(present, "ogf_id", "left_anti"), spots.join(present, "ogf_id", "left_semi"),
        BACKGROUND_DEG, S.DEGREES, "_near", left_at=AT, right_at=AT)
    wanted = present.agg(F.least(F.count("*") * ratio, F.lit(cap))).scalar()
    return sample_exact(near.where("_near = 0").select("ogf_id"), "ogf_id", wanted)


def training_rows(matrix: DataFrame, present: DataFrame, absent: DataFrame,
                  weights: DataFrame | None = None) -> DataFrame:
    """Matrix rows with label and balanced weight (times the presence weight where given)."""
    labels = present.select("ogf_id", F.lit(1.0).alias("label")).unionByName(
        absent.select("ogf_id", F.lit(0.0).alias("label")))
    out = matrix.join(labels, "ogf_id")
    if weights is not None:
        out = out.join(weights, "ogf_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        out = out.withColumn("weight", F.lit(1.0))
    out = cut(prepared(out))
    n = out.agg(F.count("*")).scalar()
    mine = F.when(F.col("label") == 1, out.where("label = 1").agg(F.count("*")).scalar()).otherwise(
        out.where("label = 0").agg(F.count("*")).scalar())
    return cut(out.withColumn("weight", F.col("weight") * n / (2 * mine)))


def prepared(df: DataFrame) -> DataFrame:
    """Model columns typed: numbers as double, categories as text, columns that are not there as nulls."""
    have = set(df.columns)
    num = {c: F.col(c).cast("double") if c in have else F.lit(None).cast("double") for c in NUMERIC}
    cat = {c: F.col(c).cast("string") if c in have else F.lit(None).cast("string") for c in CATEGORICAL}
    return df.withColumns({**num, **cat})


def preprocessing(train: DataFrame, one_hot: bool = True) -> list:
    """Fills and encodings of the columns that vary. Numbers get their median, and standard scores if ``one_hot``;
    categories get their most frequent value and one column each if ``one_hot``, else 'missing' and a code.

    A forest node tries a few columns only and becomes a leaf when none of them can split, so
    columns with one value, and the empty code of unseen categories, are left out.
    """
    seen = train.agg(
        *[F.min(c).alias(f"lo_{c}") for c in NUMERIC], *[F.max(c).alias(f"hi_{c}") for c in NUMERIC],
        *[F.count(c).alias(f"n_{c}") for c in [*NUMERIC, *CATEGORICAL]], F.count("*").alias("n"),
        *[F.min(c).alias(f"lo_{c}") for c in CATEGORICAL],
        *[F.max(c).alias(f"hi_{c}") for c in CATEGORICAL]).first()
    varies = lambda c: seen[f"lo_{c}"] != seen[f"hi_{c}"]
    used = [c for c in NUMERIC if seen[f"n_{c}"] and varies(c)] or [
        c for c in NUMERIC if seen[f"n_{c}"]][:1]
    filled = [f"{c}_filled" for c in used]
    stages = [Median(inputCols=used, outputCols=filled)] if used else []
    if one_hot and used:
        scores = [f"{c}_score" for c in used]
        stages.append(StandardScores(inputCols=filled, outputCols=scores))
        filled = scores
    kinds = [c for c in CATEGORICAL if varies(c) or not one_hot and 0 < seen[f"n_{c}"] < seen["n"]]
    codes = [f"{c}_code" for c in kinds]
    if kinds:
        whole = [f"{c}_whole" for c in kinds]
        if one_hot:
            stages.append(MostFrequent(inputCols=kinds, outputCols=whole))
        else:
            stages.append(TextFill(inputCols=kinds, outputCols=whole)._set(values=["missing"] * len(kinds)))
        stages.append(StringIndexer(inputCols=whole, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
        if one_hot:
            hot = [f"{c}_hot" for c in kinds]
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True))
            codes = hot
    stages.append(VectorAssembler(inputCols=[*filled, *codes], outputCol="features"))
    return stages


def forest(trees: int = 200, leaf: int = 5, depth: int = 12) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=leaf, maxDepth=depth, maxMemoryInMB=1024,
        weightCol="weight", seed=SEED, cacheNodeIds=False)


def fit(train: DataFrame, trees: int = 200, leaf: int = 5, one_hot: bool = True) -> PipelineModel:
    return Pipeline(stages=[*preprocessing(train, one_hot), forest(trees, leaf)]).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Presence probability per segment."""
    p = vector_to_array("probability")
    return model.transform(prepared(rows)).select("ogf_id", p[1].alias("probability"))


class Calibrated:
    """Forests fitted on two thirds of the data each, calibrated on the third left out; the
    calibrated probabilities are averaged."""

    def __init__(self, parts):
        self.parts = parts

    def score(self, rows: DataFrame) -> DataFrame:
        out = None
        for model, iso in self.parts:
            raw = score(model, rows)
            part = iso.transform(raw).select("ogf_id", F.col("calibrated").alias("p"))
            out = part if out is None else out.unionByName(part)
        return out.groupBy("ogf_id").agg(F.avg("p").alias("probability"))


def fit_calibrated(train: DataFrame, folds: int = 3, trees: int = 200, leaf: int = 5) -> Calibrated:
    placed = train.withColumn("_fold", F.pmod(F.xxhash64("ogf_id", F.lit(SEED)), F.lit(folds)))

    def one(i: int):
        rest, held = placed.where(F.col("_fold") != i), placed.where(F.col("_fold") == i)
        model = fit(rest, trees, leaf)
        scored = score(model, held).join(held.select("ogf_id", "label", "weight"), "ogf_id")
        iso = IsotonicRegression(featuresCol="probability", labelCol="label", weightCol="weight",
                                 predictionCol="calibrated")
        return model, iso.fit(scored)

    with ThreadPoolExecutor(folds) as pool:
        return Calibrated(list(pool.map(one, range(folds))))


def spatial_cv_auc(train: DataFrame, trees: int = 200, leaf: int = 5) -> float:
    """Mean AUC over the quadrants of the training area; 0.5 when no quadrant can be scored."""
    mid = lambda c: train.agg((F.min(c) + F.max(c)) / 2).scalar()
    block = (F.col(AT[0]) >= mid(AT[0])).cast("int") * 2 + (F.col(AT[1]) >= mid(AT[1])).cast("int")
    placed = cut(train.withColumn("_block", block))
    sizes = {r["_block"]: r for r in placed.groupBy("_block").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
    total, positives = sum(r["n"] for r in sizes.values()), sum(r["pos"] for r in sizes.values())
    usable = [b for b, r in sizes.items() if r["n"] >= 5 and total - r["n"] >= 10
              and 0 < r["pos"] < r["n"] and 0 < positives - r["pos"] < total - r["n"]]
    judge = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label")

    def one(b: int) -> float:
        model = fit(placed.where(F.col("_block") != b), trees, leaf)
        return judge.evaluate(model.transform(placed.where(F.col("_block") == b)))

    if not usable:
        return 0.5
    with ThreadPoolExecutor(len(usable)) as pool:
        found = list(pool.map(one, usable))
    return sum(found) / len(found)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Feature importance per source column, encoded columns summed, largest first."""
    trees = model.stages[-1]
    columns: list[str] = []
    assembler = model.stages[-2]
    sizes = {}
    for stage in model.stages:
        if hasattr(stage, "categorySizes"):
            # the last code stands for unseen categories and has no column
            sizes = {c: n - 1 for c, n in zip(stage.getOutputCols(), stage.categorySizes)}
    for c in assembler.getInputCols():
        source = c.removesuffix("_score").removesuffix("_filled").removesuffix("_hot").removesuffix("_code")
        columns += [source] * int(sizes.get(c, 1))
    total: dict[str, float] = {}
    for name, v in zip(columns, trees.featureImportances.toArray()):
        total[name] = total.get(name, 0.0) + float(v)
    return sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))


def train_species(rows: DataFrame, matrix: DataFrame, species: str, trees: int = 200,
                  calibrated: bool = True, snapped: DataFrame | None = None):
    """Model, training rows and a metadata dict; None when there are too few presences or no absence."""
    present = cut(presence(rows, matrix, species, snapped=snapped))
    n = present.count()
    if n < MIN_PRESENCES:
        return None
    absent = cut(target_group_absence(rows, matrix, present, snapped=snapped))
    if absent.isEmpty():
        return None
    train = training_rows(matrix, present, absent)
    with ThreadPoolExecutor(3) as pool:
        whole, auc = pool.submit(fit, train, trees), pool.submit(spatial_cv_auc, train, trees)
        parts = pool.submit(fit_calibrated, train, trees=trees) if calibrated else whole
        model, final = whole.result(), parts.result()
        meta = {"species": species, "n_presence": n, "n_absence": absent.count(), "n_training": train.count(), "trees": trees,
                "auc": auc.result(), "importances": importances(model)}
    return final, train, meta


def train_soft(rows: DataFrame, matrix: DataFrame, species: str, trees: int = 200,
               leaf: int = 1):
    """Variant with soft presence weights for obscured records and a buffered background."""
    spots = matrix.select("ogf_id", F.col(AT[0]).alias("lat"), F.col(AT[1]).alias("lng"))
    weights = cut(soft_labels(of_species(rows, species), spots))
    present = weights.select("ogf_id")
    if present.count() < MIN_PRESENCES:
        return None
    absent = random_background(matrix, present)
    train = training_rows(matrix, present, absent, weights)
    return fit(train, trees, leaf, one_hot=False), train
