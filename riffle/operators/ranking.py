"""Per-group choice and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of conservation statuses.
STATUS_SEVERITY = {
    "Endangered": 0, "Threatened": 1, "Special Concern": 2, "Extirpated": 3, "Not at Risk": 4,
    "No Status": 5,
}


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    """First k rows per group. A rank limit is applied before the shuffle as well as after it,
    so a crowded group sends at most k rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumn("_rn", F.col("_rn").cast("bigint")).withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, group, order, 1)


def top_two(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Best and second-best label per key as columns: a running pair kept by two aggregates."""
    ranked = top_per_group(df, [key], [F.desc(score), F.col(label)], 2, "rk")
    pick = lambda c, r: F.max(F.when(F.col("rk") == r, F.col(c)))
    return ranked.groupBy(key).agg(
        pick(label, 1).alias("top1"), pick(score, 1).alias("top1_score"),
        pick(label, 2).alias("top2"), pick(score, 2).alias("top2_score"))


def severity(status: str | Column) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    pairs = [F.lit(x) for kv in STATUS_SEVERITY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(99))


def convenience_rank(df: DataFrame, distance: str, area: str, limit: int, key: str) -> DataFrame:
    """0.6 of relative distance plus 0.4 of relative smallness, smallest first."""
    size = F.coalesce(F.col(area), F.lit(0.0))
    top = lambda c: F.coalesce(
        F.nullif(df.agg(F.max(c)).scalar(), F.lit(0.0)), F.lit(1.0))
    score = 0.6 * F.col(distance) / top(F.col(distance)) + 0.4 * (1 - size / top(size))
    return df.withColumn("convenience", score).orderBy("convenience", key).limit(limit)
