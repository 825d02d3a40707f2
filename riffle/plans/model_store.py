"""Trained species models on disk: saved with Spark ML's writers, listed and scored from there.

Layout of a base folder: ``models/<slug>/<version>/<save>/<part>/forest`` and ``.../curve`` hold the fitted pipelines and the
isotonic curves of a calibrated model (one part per fold; an uncalibrated model is one part without a curve);
``metadata/<one folder a save>`` holds the row of a (species, version). The row is written last, so a model whose writing
broke off is not listed, and into a folder of its own, so any number of species can be saved at once; a newer row of the
same species and version counts for an older one.
"""

from __future__ import annotations

import datetime
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.plans import sdm as M
from riffle.session import cut

SCHEMA = ("species string, slug string, version string, trained_at timestamp, n_presence bigint, n_absence bigint, n_training bigint, auc double, trees int, "
          "calibrated boolean, confidence_tier string, parts int, importances map<string,double>, path string")


def slug(species: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", species.lower()).strip("_")


def version_of(day: datetime.date) -> str:
    return f"rf-{day:%Y%m%d}"


class ModelStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def save(self, species: str, model: PipelineModel | M.Calibrated, meta: dict, version: str, trained_at: datetime.datetime | None = None) -> None:
        """Write a model and then its row. ``meta``: n_presence, n_absence, n_training, auc, trees, importances."""
        calibrated = isinstance(model, M.Calibrated)
        parts = model.parts if calibrated else [(model, None)]
        at = trained_at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        path = f"{self.base}/models/{slug(species)}/{version}/{uuid.uuid4().hex}"
        pieces = [(made, f"{path}/{i}/{name}") for i, part in enumerate(parts) for name, made in zip(("forest", "curve"), part) if made is not None]
        with ThreadPoolExecutor(len(pieces)) as pool:
            list(pool.map(lambda piece: piece[0].write().overwrite().save(piece[1]), pieces))
        n = int(meta["n_presence"])
        tier = "high" if n >= 50 else "medium" if n >= 15 else "low"
        row = (species, slug(species), version, at, n, int(meta["n_absence"]), int(meta["n_training"]), float(meta["auc"]), int(meta["trees"]), calibrated, tier,
               len(parts), {k: float(v) for k, v in meta["importances"]}, path)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{self.base}/metadata/{slug(species)}-{version}-{uuid.uuid4().hex}")

    def metadata(self) -> DataFrame:
        """The newest row of each (species, version); no rows where nothing was saved."""
        if not self._exists(f"{self.base}/metadata"):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.base}/metadata/*")
        newest = Window.partitionBy("species", "version").orderBy(F.desc("trained_at"), F.desc("path"))
        return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def latest(self) -> DataFrame:
        """The newest version of each species."""
        newest = Window.partitionBy("species").orderBy(F.desc("trained_at"), F.desc("version"))
        return self.metadata().withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def list_trained_species(self) -> list[str]:
        return [r["species"] for r in self.metadata().select("species").distinct().orderBy("species").collect()]

    def load_metadata(self, species: str, version: str | None = None):
        """The row of a species (its newest version unless one is named); None if it was never trained."""
        rows = self.metadata().where(F.col("species") == species) if version else self.latest().where(F.col("species") == species)
        return (rows.where(F.col("version") == version) if version else rows).first()

    def load(self, species: str, version: str | None = None) -> PipelineModel | M.Calibrated | None:
        row = self.load_metadata(species, version)
        if row is None:
            return None
        return self._read(row)

    @staticmethod
    def _read(row) -> PipelineModel | M.Calibrated:
        def part(i: int):
            forest = PipelineModel.load(f"{row['path']}/{i}/forest")
            return forest, IsotonicRegressionModel.load(f"{row['path']}/{i}/curve") if row["calibrated"] else None

        with ThreadPoolExecutor(row["parts"]) as pool:
            parts = list(pool.map(part, range(row["parts"])))
        return M.Calibrated(parts) if row["calibrated"] else parts[0][0]

    def predict(self, species: str, matrix: DataFrame, version: str | None = None) -> DataFrame | None:
        """ogf_id, species, presence_probability, confidence_tier and model_version of every segment from the stored
        model; None if there is none."""
        row = self.load_metadata(species, version)
        return None if row is None else self._scored(row, matrix)

    def _scored(self, row, matrix: DataFrame) -> DataFrame:
        model = self._read(row)
        scored = model.score(matrix) if isinstance(model, M.Calibrated) else M.score(model, matrix)
        return scored.select("ogf_id", F.lit(row["species"]).alias("species"), F.col("probability").alias("presence_probability"),
                             F.lit(row["confidence_tier"]).alias("confidence_tier"), F.lit(row["version"]).alias("model_version"))

    def predict_all(self, matrix: DataFrame, parallel: int = 4) -> DataFrame:
        """The same for all stored species, newest versions; the rows of the metadata are read once."""
        with ThreadPoolExecutor(parallel) as pool:
            parts = list(pool.map(lambda row: self._scored(row, matrix), self.latest().orderBy("species").collect()))
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "ogf_id long, species string, presence_probability double, confidence_tier string, model_version string")
        return out


def train_and_save(store: ModelStore, rows: DataFrame, matrix: DataFrame, species: list[str] | None, version: str, trees: int = 200,
                   calibrated: bool = True, parallel: int = 3) -> list[str]:
    """Train and save the named species, or all of the records if none is named, as far as they have enough presences;
    the names saved, in order. Each species grows up to eight forests at once, so a few species fill a driver."""
    snapped = cut(M.snapped_records(rows, matrix))

    def one(name: str) -> str | None:
        got = M.train_species(rows, matrix, name, trees, calibrated, snapped)
        if got is None:
            return None
        model, _, meta = got
        store.save(name, model, meta, version)
        return name

    with ThreadPoolExecutor(parallel) as pool:
        return [n for n in pool.map(one, M.trainable_species(snapped) if species is None else species) if n is not None]
