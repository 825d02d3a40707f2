"""Ordered computations that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.session import cut


def numbered_with_next(df: DataFrame, key: list[str], order: list[str], number: str,
                       next_of: str, name: str) -> DataFrame:
    """Row number within ``key`` and the following row's ``next_of``.

    Rows are range-partitioned on key and order, so a crowded key spreads over many partitions;
    each piece is numbered apart, and one small row per (partition, key) carries the offsets and
    the first value of the next piece.
    """
    placed = cut(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    piece = Window.partitionBy("_part", *key).orderBy(*order)
    local = placed.withColumn("_rn", F.row_number().over(piece)).withColumn(
        "_next", F.lead(next_of).over(piece))
    sizes = placed.groupBy("_part", *key).agg(
        F.count("*").alias("_size"),
        F.min_by(next_of, F.struct(*order)).alias("_head"))
    along = Window.partitionBy(*key).orderBy("_part")
    before = F.coalesce(
        F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(
        "_part", *key, before.alias("_before"), F.lead("_head").over(along).alias("_follow"))
    joined = local.join(starts, ["_part", *key])
    return joined.withColumns({
        number: (F.col("_before") + F.col("_rn")).cast("bigint"),
        name: F.coalesce(F.col("_next"), F.col("_follow")),
    }).drop("_part", "_rn", "_next", "_before", "_follow")


def trailing_means(df: DataFrame, key: str, ts: str, values: dict[str, str],
                   seconds: int = 86_400) -> DataFrame:
    """Mean of each value over the trailing ``seconds``, the current row included.

    Rows of one key and instant are summed first. Time is cut into blocks of that length, so a window is
    the head of its own block, summed forwards, and the tail of the block before, summed backwards from where
    the window begins: two growing sums, whatever the number of rows in a window.
    """
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    sums = {f"_s{i}": F.sum(v) for i, v in enumerate(values.values())}
    counts = {f"_c{i}": F.count(v) for i, v in enumerate(values.values())}
    instants = cut(df.groupBy(F.col(key).alias("_k"), sec.alias("_t")).agg(
        *[e.alias(n) for n, e in (sums | counts).items()]).where(F.col("_t").isNotNull()))
    block = lambda t: F.floor(t / width)
    part = instants.withColumn("_block", block(F.col("_t")))
    head = Window.partitionBy("_k", "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    heads = part.select("_k", "_t", *[F.sum(n).over(head).alias(n) for n in sums | counts])
    begins = instants.select("_k", (F.col("_t") - width).alias("_t"), F.lit(1).alias("_begin")).withColumn(
        "_block", block(F.col("_t")))
    tail = Window.partitionBy("_k", "_block").orderBy(F.desc("_t"), "_begin").rowsBetween(Window.unboundedPreceding, 0)
    tails = part.withColumn("_begin", F.lit(0)).unionByName(begins, allowMissingColumns=True).withColumns(
        {n: F.sum(n).over(tail) for n in sums | counts}).where("_begin = 1").select(
        "_k", (F.col("_t") + width).alias("_t"), *sums, *counts)
    both = heads.unionByName(tails).groupBy("_k", "_t").agg(*[F.sum(n).alias(n) for n in sums | counts])
    means = both.select(F.col("_k"), F.col("_t"), *[
        (F.col(f"_s{i}") / F.nullif(F.col(f"_c{i}"), F.lit(0))).alias(name) for i, name in enumerate(values)])
    named = df.drop(*values) if set(values) & set(df.columns) else df
    return named.join(means, named[key].eqNullSafe(means["_k"]) & (
        F.unix_micros(named[ts].cast("timestamp")) == means["_t"])).drop("_k", "_t")


def closest_in_time(df: DataFrame, key: str, ts: str, tie: str, seconds_back: int,
                    carry: list[str], prefix: str, reach: int | None = None) -> DataFrame:
    """Each row with the same key's earlier row nearest to ``seconds_back`` before it.

    Readings and wanted instants are merged in time order and range-partitioned, so a key may
    span any number of partitions. Each piece looks back and ahead on its own; one row per
    (partition, key) carries the last reading before and the first one after the piece. Equal
    distances go to the earlier reading, equal instants to the smallest ``tie``. ``reach`` limits
    the distance in seconds; rows without a candidate keep nulls.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    back = seconds_back * 1_000_000
    readings = df.groupBy(F.col(key).alias("_k"), micros.alias("_t")).agg(
        F.min(F.struct(F.col(tie).alias("_tie"), *carry)).alias("_r"))
    readings = readings.select("_k", "_t", F.lit(0).alias("_kind"), F.struct(
        "_t", "_r").alias("_r"))
    asked = df.select(F.col(key).alias("_k"), (micros - back).alias("_t"),
                      F.lit(1).alias("_kind")).distinct()
    merged = readings.unionByName(asked, allowMissingColumns=True)
    placed = cut(merged.repartitionByRange("_k", "_t", "_kind").withColumn(
        "_part", F.spark_partition_id()))
    piece = Window.partitionBy("_part", "_k").orderBy("_t", "_kind")
    # looking ahead is looking back in the reversed order: growing frames cost one pass each
    rear = Window.partitionBy("_part", "_k").orderBy(F.desc("_t"), F.desc("_kind"))
    local = placed.withColumns({
        "_before": F.last("_r", True).over(piece.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.last("_r", True).over(rear.rowsBetween(Window.unboundedPreceding, 0)),
    }).where("_kind = 1")
    ends = placed.groupBy("_part", "_k").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_r"))).alias("_last"),
        F.min(F.when(F.col("_kind") == 0, F.col("_r"))).alias("_first"))
    along = Window.partitionBy("_k").orderBy("_part")
    ahead = Window.partitionBy("_k").orderBy(F.desc("_part"))
    ends = ends.select(
        "_part", "_k",
        F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.last("_first", True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("_out"))
    spans = local.join(ends, ["_part", "_k"]).select(
        "_k", "_t", F.coalesce("_before", "_in").alias("_b"), F.coalesce("_after", "_out").alias("_a"))
    gap_b, gap_a = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    ahead_ok = F.coalesce(F.col("_a._t") < F.col("_t") + back, F.lit(False))
    use_ahead = ahead_ok & (F.col("_b").isNull() | (gap_a < gap_b))
    best = F.when(use_ahead, F.col("_a")).otherwise(F.col("_b"))
    found = spans.select("_k", "_t", best.alias("_m"))
    if reach is not None:
        near = F.abs(F.col("_m._t") - F.col("_t")) <= reach * 1_000_000
        found = found.withColumn("_m", F.when(near, F.col("_m")))
    found = found.select("_k", "_t", *[F.col(f"_m._r.{c}").alias(prefix + c) for c in carry])
    return df.join(found, (df[key] == found["_k"]) & (micros - back == found["_t"]), "left").drop(
        "_k", "_t")
