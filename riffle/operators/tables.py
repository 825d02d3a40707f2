"""Keyed table maintenance: upsert, insert-if-absent, retention, versions, point updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(target: DataFrame, batch: DataFrame, key: list[str], arrival: Column) -> DataFrame:
    """Rows of both by key, the batch replacing the target; within the batch the row of greatest
    ``arrival`` wins (its file, offset or time). Only keys present in the batch are deduplicated; the
    rest of the target streams through an anti join. Columns may be of any type, maps included."""
    order = arrival
    rows = F.struct(*[F.col(c) for c in batch.columns])
    latest = batch.groupBy(*key).agg(F.max_by(rows, order).alias("r")).select("r.*")
    kept = target.join(latest.select(*key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def insert_absent(target: DataFrame, batch: DataFrame, key: list[str], arrival: Column) -> DataFrame:
    """Append only rows whose key the target lacks; the least arrival wins inside the batch."""
    order = arrival
    rows = F.struct(*[F.col(c) for c in batch.columns])
    fresh = batch.groupBy(*key).agg(F.min_by(rows, order).alias("r")).select("r.*")
    return target.unionByName(
        fresh.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def keep_since(df: DataFrame, ts: str, asof: str, days: int = 7) -> DataFrame:
    return df.where(F.col(ts) >= F.to_timestamp(F.lit(asof)) - F.make_interval(days=F.lit(days)))


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """The schema's columns in order: absent ones added, nulls filled where a default is known; then
    the columns in ``keep`` as they are."""
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for f in schema.fields:
        default = F.lit(defaults.get(f.name)).cast(f.dataType)
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append(F.coalesce(value, default).alias(f.name))
    return df.select(*out, *(keep or []))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows with its schema where it was never written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    return with_defaults(spark.read.option("mergeSchema", "true").parquet(path), schema)


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reason they were turned away."""
    tagged = df.withColumn("_reject_reason", reason)
    good = tagged.where(F.col("_reject_reason").isNull()).drop("_reject_reason")
    return good, tagged.where(F.col("_reject_reason").isNotNull())


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for a list of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def point_update(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite the given non-null columns of the listed rows; other rows pass unchanged."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = target.join(new, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in target.columns])


def append_with_ids(target: DataFrame, batch: DataFrame, id_column: str,
                    order: list[str]) -> DataFrame:
    """Append rows under increasing ids that continue the target's.

    Numbers come from per-partition counts over a range partitioning, not from one global sort
    task.
    """
    start = target.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    numbered = row_numbers(batch, order, "_n").withColumn(
        id_column, (start + F.col("_n")).cast("bigint")).drop("_n")
    return target.unionByName(numbered, allowMissingColumns=True)


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based consecutive numbers in the given order, computed partition by partition."""
    from riffle.session import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_mono", F.monotonically_increasing_id()))
    # one row per partition
    sizes = placed.groupBy("_part").agg(
        F.count("*").alias("_size"), F.min("_mono").alias("_first"))
    before = F.coalesce(F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_before") + F.col("_mono") - F.col("_first") + 1
    ).drop("_part", "_mono", "_first", "_before")


def versions(df: DataFrame, key: list[str], order: list[str], id_column: str) -> DataFrame:
    """Refinement chains: version number, the id that replaced each row, and the current one."""
    from riffle.operators.windows import numbered_with_next

    out = numbered_with_next(df, key, order, "version", id_column, "contradicted_by")
    return out.withColumn("is_current", F.col("contradicted_by").isNull())


def refine(target: DataFrame, new_rows: DataFrame, id_column: str, replaces: str) -> DataFrame:
    """Add refinements: each new row points at the row it replaces, which stops being current."""
    old = target.select(
        F.col(id_column).alias(replaces), F.col("version").alias("_v"))
    fresh = new_rows.join(old, replaces, "left").withColumns({
        "version": F.coalesce(F.col("_v") + 1, F.lit(1)).cast("bigint"),
        "is_current": F.lit(True), "contradicted_by": F.lit(None).cast("bigint"),
    }).drop("_v", replaces)
    retired = new_rows.select(
        F.col(replaces).alias(id_column), F.col(id_column).alias("_by")
    ).groupBy(id_column).agg(F.max("_by").alias("_by"))
    kept = target.join(retired, id_column, "left").withColumns({
        "is_current": F.col("is_current") & F.col("_by").isNull(),
        "contradicted_by": F.coalesce(F.col("_by"), F.col("contradicted_by")),
    }).drop("_by")
    return kept.unionByName(fresh, allowMissingColumns=True)
