"""Optimal length buckets and token-budget batches.

The histogram of lengths over all documents is bounded by the greatest length, since longer documents
are cut into pieces of that length first. Dynamic programming over it picks the bucket boundaries of
least padding: ``cost[k][j]``, the least padding of all lengths up to the j-th with k buckets, is the
minimum over i of ``cost[k-1][i]`` plus the padding of lengths i+1..j to the j-th; prefix sums give that
padding at once. Inside a bucket of length b, batches of ``budget // b`` pieces are dealt out in order of
document; every piece is padded to b, so no batch exceeds the budget.

Numbering the pieces of a bucket needs no single task: pieces are sorted into ranges of (bucket,
document), counted per range and bucket, and numbered from the sums of the ranges before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.flat import text_slices
from riffle.llm.shared import dropped, keyed, table, written
from riffle.llm.token_files import END, Encoder, tokenizer_path

BUCKETS, GREATEST, BUDGET = 16, 4096, 65_536


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, the last is the greatest length) of at most ``buckets`` buckets with the
    least padding, and that padding. ``lengths`` ascend. Ties: the least boundaries from the top."""
    n = len(lengths)
    if not n:
        return [], 0
    many = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.int64)
    cost = np.concatenate([[0], np.full(n, np.iinfo(np.int64).max // 4)])
    choices = []
    for _ in range(min(buckets, n)):
        best, choice = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            tries = cost[:j] + lengths[j - 1] * (many[j] - many[:j]) - (total[j] - total[:j])
            i = int(tries.argmin())
            if tries[i] < best[j]:
                best[j], choice[j] = tries[i], i
        cost = best
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        if choice[j] >= 0:
            ends.append(int(lengths[j - 1]))
            j = int(choice[j])
    return ends[::-1], int(cost[n])


def _measured(path: str, extra: int):
    def run(batches):
        coder = Encoder.of(path)
        for batch in batches:
            for part, texts in text_slices(batch):
                _, counts = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(counts + extra)], names=["doc_id", "th", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, end: int | None = END) -> DataFrame:
    """doc_id, th and n_tokens (with the end id, unless ``end`` is None) of every row."""
    return keyed(docs, "text").mapInArrow(_measured(path or tokenizer_path(), int(end is not None)), "doc_id long, th long, n_tokens long")


def packed(lengths: DataFrame, buckets: int = BUCKETS, greatest: int = GREATEST, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, th, piece, start, n_tokens (of the piece), bucket (its length), batch
    (its number in the bucket, from 0) and slot (its place in the batch).

    ``lengths`` has doc_id, th and n_tokens. Pieces are consecutive stretches of ``greatest`` tokens, the
    last one shorter. Documents without tokens (or with a null count) have no piece. Null ids come first;
    rows that repeat are packed each. ``budget`` must be ``greatest`` at least.
    """
    if budget < greatest:
        raise ValueError("a batch must hold the greatest length")
    if greatest > 1 << 16 or buckets < 1:
        raise ValueError("greatest must be at most 65,536 and buckets at least 1")
    n = F.col("n_tokens")
    pieces = lengths.select("doc_id", "th", n).filter(n > 0).select(
        "doc_id", "th", n.alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / greatest))).alias("piece"))
    pieces = written(pieces.select("doc_id", "th", "piece", (F.col("piece") * greatest).alias("start"),
                                   F.least(F.lit(greatest), F.col("whole") - F.col("piece") * greatest).alias("n_tokens")))
    histogram = sorted((r.n_tokens, r.n) for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())  # at most `greatest` rows
    ends, _ = best_boundaries(np.array([x for x, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    spark = lengths.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["bucket", F.asc_nulls_first("doc_id"), "th", "piece"]
    ranged = written(pieces.withColumn("bucket", bucket).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("part", F.spark_partition_id()).mapInArrow(_numbered, "doc_id long, th long, piece long, start long, n_tokens long, bucket long, part int, own long"))
    sums = ranged.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and bucket in it
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
    offsets = sums.select(F.col("bucket").alias("b"), F.col("part").alias("p"), before.alias("before"))
    dropped(pieces)
    placed = ranged.join(offsets, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("before") + F.col("own"))
    per = F.floor(F.lit(budget) / F.col("bucket"))
    return placed.select("doc_id", "th", "piece", "start", "n_tokens", "bucket", F.floor(F.col("at") / per).alias("batch"), (F.col("at") % per).alias("slot"))


def _numbered(batches):
    """Count the rows of each bucket in the order they come."""
    held, seen = None, 0
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        own = np.empty(len(bucket), np.int64)
        for s, e in _stretches(bucket):
            if bucket[s] != held:
                held, seen = bucket[s], 0
            own[s:e] = np.arange(seen, seen + e - s)
            seen += e - s
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "own"])


def _stretches(values: np.ndarray):
    if len(values):
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)])


def op8_packing(spark, folder: str) -> DataFrame:
    return packed(token_counts(table(spark, folder, "documents"))).drop("th")
