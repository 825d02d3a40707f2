"""Savable preprocessing stages of the models: fills for missing values, and standard scores.

Each is a Spark ML estimator whose model holds one value a column (two for standard scores) as parameters, so it is
saved and loaded with the pipeline it stands in.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Stage(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)


class _Filled(_Stage, Model):
    def _pairs(self):
        return zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("values"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: F.coalesce(F.col(c), F.lit(v)) for c, out, v in self._pairs()})


class TextFill(_Filled):
    """Missing texts become the column's value."""

    values = Param(Params._dummy(), "values", "one text a column", TypeConverters.toListString)


class NumberFill(_Filled):
    """Missing numbers become the column's value."""

    values = Param(Params._dummy(), "values", "one number a column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        given = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return df.withColumns({out: F.coalesce(given(c), F.lit(v)) for c, out, v in self._pairs()})


class MostFrequent(_Stage, Estimator):
    """Fits ``TextFill`` to each column's most frequent value; ties go to the smallest, a column without values
    gets 'missing'. One pass: the counts of all columns are one grouped table."""

    def _fit(self, df: DataFrame) -> TextFill:
        columns = self.getInputCols()
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
        counts = long.select("x.*").where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
        best = {r["name"]: r["m"]["value"] for r in counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("m")).collect()}
        model = TextFill(inputCols=columns, outputCols=self.getOutputCols())
        return model._set(values=[best.get(c, "missing") for c in columns])


class Median(_Stage, Estimator):
    """Fits ``NumberFill`` to each column's median, the mean of the two middle values of an even number; a column
    without values gets 0. Two passes whatever the number of columns, with sketches of bounded size: exact up to
    ``ACCURACY`` rows, beyond that within one row in ``ACCURACY`` of the middle."""

    ACCURACY = 10_000

    def _fit(self, df: DataFrame) -> NumberFill:
        columns = self.getInputCols()
        given = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
        sizes = given.agg(*[F.count(c).alias(c) for c in given.columns]).first()
        some = [c for c in given.columns if sizes[c]]
        spots = {c: (((sizes[c] + 1) // 2 - 0.5) / sizes[c], (sizes[c] // 2 + 0.5) / sizes[c]) for c in some}
        found = given.agg(*[F.percentile_approx(c, list(spots[c]), self.ACCURACY).alias(c) for c in some]).first() if some else {}
        model = NumberFill(inputCols=columns, outputCols=self.getOutputCols())
        return model._set(values=[sum(found[c]) / 2 if c in spots else 0.0 for c in given.columns])


class Scores(_Stage, Model):
    """Standard scores by stored means and spreads; a spread of 0 counts as 1."""

    means = Param(Params._dummy(), "means", "one number a column", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "one number a column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("spreads"))
        return df.withColumns({out: (F.col(c) - m) / (s or 1.0) for c, out, m, s in rows})


class StandardScores(_Stage, Estimator):
    """Fits ``Scores`` with the population's standard deviation."""

    def _fit(self, df: DataFrame) -> Scores:
        columns = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        model = Scores(inputCols=columns, outputCols=self.getOutputCols())
        return model._set(means=[float(row[f"m{i}"] or 0.0) for i in range(len(columns))], spreads=[float(row[f"s{i}"] or 0.0) for i in range(len(columns))])
