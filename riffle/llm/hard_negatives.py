"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds (in the manner of L2AP).

A score is the integer inner product of two vectors of floor(256 x). For every anchor the search lowers a threshold
until what it asks for is full:

* positives: the best ``POSITIVES`` rows of the anchor's label;
* negatives: for each positive's window of scores, the best ``NEGATIVES`` rows of other labels inside it.

A round looks up all anchors that are still open at their thresholds. Rows and anchors are packed into blocks of
bounded size, sorted by label and norm; a pair of blocks whose norms cannot reach the least threshold, or whose labels
cannot match, is not made. Inside a pair of blocks (``reached``):

1. dimensions are ordered by their energy in the rows; of each row the index holds the leading dimensions only, up to
   where the norm of the rest, times the greatest anchor norm, is under the threshold: what shares no indexed dimension
   with an anchor cannot reach it;
2. scores are accumulated over slices of indexed dimensions; after a slice, rows and anchors go whose partial scores,
   plus the product of the norms of what is left, are under the threshold for every partner;
3. surviving pairs get the part that is not indexed, and are held against the threshold itself.

Bounds are taken a little wide, sums are exact, so no pair is lost. Each pair of blocks returns the best of each window
only, and Spark merges these per window. Every open anchor meets all rows: the anchors are a stated query set, in blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.shared import dropped, table, written

POSITIVES, NEGATIVES = 5, 10
SCALE = 256
#: Rows and bytes of a block of rows, anchors of a block, pairs of blocks a task takes, anchors looked up at once.
ROWS, ROW_BYTES, ANCHORS, PAIRS, AT_ONCE = 8192, 4 << 20, 1024, 8, 64
SLICE = 16
#: Thresholds of the negatives' rounds, as hundredths of the least positive score; the last is the windows' own.
STEPS = (72, 50, 30)
EXACT = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, h, label, v of the rows that take part: no null id, label, vector or component, none that is not finite. ``v`` is floor(256 x),
    ``h`` tells rows of one vec_id apart."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v")).withColumn("h", F.xxhash64("label", "v"))


def _norm2(v: str = "v"):
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _matrix(lists: list[list[int]]) -> np.ndarray:
    """Rows as one matrix; shorter ones are filled up with zeros."""
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _blocks(most: int, extra: tuple[str, ...]):
    """Pack the rows of a partition into blocks. Neighbours equal in id and content are one row."""
    def run(batches):
        number = 0
        for batch in batches:
            keys = list(zip(batch.column("vec_id").to_pylist(), batch.column("h").to_pylist()))
            fresh = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
            vectors = batch.column("v").take(pa.array(fresh, pa.int64())).to_pylist()
            part = batch.column("part")[0].as_py() if len(keys) else 0
            width = max(map(len, vectors), default=0)
            size = max(1, min(most, ROW_BYTES // (8 * max(1, width))))
            for s in range(0, len(fresh), size):
                at = pa.array(fresh[s:s + size], pa.int64())
                m = _matrix(vectors[s:s + size])
                norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
                labels = batch.column("label").take(at)
                low = batch.column("t").take(at).to_pylist() if "t" in extra else [0]
                head = [pa.array([(part << 32) + number]), pa.array([m.shape[1]]), pa.array([float(norms.max(initial=0.0))]), pa.array([float(min(low))]),
                        pa.array([min(labels.to_pylist())]), pa.array([max(labels.to_pylist())]), pa.array([m.tobytes()], pa.binary())]
                lists = [pa.array([batch.column(c).take(at).to_pylist()], pa.list_(pa.list_(pa.int64()) if c == "ps" else pa.int64())) for c in ("vec_id", "h", "label", *extra)]
                yield pa.RecordBatch.from_arrays([*head, *lists], names=["block", "width", "norm", "low", "label_low", "label_high", "matrix", "vec_id", "h", "label", *extra])
                number += 1

    return run


HEAD = "block long, width long, norm double, low double, label_low long, label_high long, matrix binary, vec_id array<long>, h array<long>, label array<long>"


def _packed(rows: DataFrame, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A table of blocks, sorted by label and norm, so that blocks are alike inside."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["label", "norm", "vec_id", "h"]
    kinds = "".join(f", {c} array<{'array<long>' if c == 'ps' else 'long'}>" for c in extra)
    sorted_rows = rows.withColumn("norm", F.sqrt(_norm2())).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(sorted_rows.withColumn("part", F.spark_partition_id().cast("long")).select("part", "vec_id", "h", "label", "v", *extra).mapInArrow(_blocks(most, extra), HEAD + kinds))


def reached(queries: np.ndarray, thresholds: np.ndarray, rows: np.ndarray):
    """(query, row, score) of all pairs whose score is at least the query's threshold, which is not negative."""
    exact, slack = np.float64, 1e-6
    if len(queries) and len(rows):
        most = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max()) * np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max())
        if most >= EXACT:  # beyond exact floating sums: 64-bit integers
            exact = np.int64
        slack += most * 1e-12
    width = max(queries.shape[1], rows.shape[1])
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    order = np.concatenate([order, np.arange(rows.shape[1], width)]).astype(np.int64)
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))[:, order].astype(exact)
    x, y = wide(queries), wide(rows)
    rest = lambda m: np.sqrt(np.pad(np.cumsum(m[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1], ((0, 0), (0, 1))))
    x_rest, y_rest = rest(x), rest(y)
    wider = 1 + 1e-9
    # the index: of a row only the dimensions before the first suffix that no query can raise to its threshold
    least = float(thresholds.min()) if len(thresholds) else 0.0
    indexed = (y_rest * (x_rest[:, 0].max(initial=0.0) * wider) >= max(least, 0.0)).sum(axis=1) if least > 0 else np.full(len(y), width)
    postings = np.where(np.arange(width) < indexed[:, None], y, 0)
    live = np.flatnonzero(indexed > 0) if least > 0 else np.arange(len(y))
    out = []
    for s in range(0, len(x), AT_ONCE):
        q = np.arange(s, min(len(x), s + AT_ONCE))
        r, t = live, thresholds[q].astype(np.float64)
        sums = np.zeros((len(q), len(r)), exact)
        for d in range(0, width, SLICE):
            sums += x[q, d:d + SLICE] @ postings[r, d:d + SLICE].T
            after = min(width, d + SLICE)
            if after < width and least > 0:
                k = np.minimum(indexed[r], after)
                could = sums + x_rest[np.ix_(q, k)] * (y_rest[r, k] * wider) >= t[:, None] - slack
                rows_on, queries_on = could.any(axis=0), could.any(axis=1)
                if not rows_on.all() or not queries_on.all():
                    sums = sums[queries_on][:, rows_on]
                    q, r, t = q[queries_on], r[rows_on], t[queries_on]
            if not len(q) or not len(r):
                break
        if not len(q) or not len(r):
            continue
        partial = least > 0 and (indexed[r] < width).any()
        bound = sums + x_rest[np.ix_(q, indexed[r])] * (y_rest[r, indexed[r]] * wider) if partial else sums
        i, j = np.nonzero(bound >= t[:, None] - slack)
        score = sums[i, j]
        if partial:
            left = y[r] - postings[r]
            short = np.flatnonzero(indexed[r[j]] < width)
            score[short] += np.einsum("ij,ij->i", x[q[i[short]]], left[j[short]])
        score = score.astype(np.int64)
        ok = score >= thresholds[q[i]]
        out.append((q[i[ok]], r[j[ok]], score[ok]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _best(scores: np.ndarray, ids: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties: the least id."""
    at = np.arange(len(scores))
    if len(at) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((h[at], ids[at], -scores[at]))[:k]]


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(row[f"{prefix}vec_id"], np.int64)
    return (np.frombuffer(row[f"{prefix}matrix"], np.int64).reshape(len(ids), row[f"{prefix}width"]), ids,
            np.array(row[f"{prefix}h"], np.int64), np.array(row[f"{prefix}label"], np.int64))


def _looked_up(same: bool, k: int):
    names = ["anchor_id", "ah", "p", "vec_id", "vh", "score"]

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                y, ids, h, labels = _unpacked(row)
                x, anchors, ah, own = _unpacked(row, "a_")
                t = np.array(row["a_t"], np.int64)
                found = []
                q, r, score = reached(x, t, y)
                fit = (labels[r] == own[q]) == same
                fit &= ids[r] != anchors[q]
                q, r, score = q[fit], r[fit], score[fit]
                order = np.argsort(q, kind="stable")
                q, r, score = q[order], r[order], score[order]
                bounds = np.searchsorted(q, np.arange(len(anchors) + 1))
                for i in np.unique(q).tolist():
                    rr, ss = r[bounds[i]:bounds[i + 1]], score[bounds[i]:bounds[i + 1]]
                    for p in [None] if same else row["a_ps"][i]:
                        inside = np.arange(len(ss)) if same else np.flatnonzero((100 * ss >= 30 * p) & (100 * ss <= 90 * p))
                        b = inside[_best(ss[inside], ids[rr[inside]], h[rr[inside]], k)]
                        found.append((np.full(len(b), anchors[i]), np.full(len(b), ah[i]), np.full(len(b), -1 if p is None else p), ids[rr[b]], h[rr[b]], ss[b]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=names)

    return run


FOUND = "anchor_id long, ah long, p long, vec_id long, vh long, score long"


def _round(blocks: DataFrame, state: DataFrame, same: bool, k: int) -> DataFrame:
    """Best k rows of every open anchor (and window) at its threshold: anchor_id, ah, p, vec_id, vh, score."""
    asked = _packed(state, ANCHORS, ("t",) if same else ("t", "ps"))
    spark = state.sparkSession
    heads = blocks.select("block", "norm", "label_low", "label_high")
    for_rows = asked.select(F.col("block").alias("a_block"), F.col("norm").alias("a_norm"), "low", F.col("label_low").alias("a_low"), F.col("label_high").alias("a_high"))
    could = F.col("norm") * F.col("a_norm") * (1 + 1e-9) >= F.col("low")
    if same:
        could &= (F.col("label_low") <= F.col("a_high")) & (F.col("a_low") <= F.col("label_high"))
    else:
        could &= ~((F.col("label_low") == F.col("label_high")) & (F.col("a_low") == F.col("a_high")) & (F.col("label_low") == F.col("a_low")))
    # one row for each block of anchors: they are paired with the blocks of rows by number, not by a cross join
    numbered = for_rows.select("*", F.row_number().over(Window.orderBy("a_block")).alias("nth"))
    many = asked.count()
    pairs = heads.select("*", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("nth")).join(numbered, "nth").filter(could).select("block", "a_block") if many else None
    if pairs is None:
        dropped(asked)
        return written(spark.createDataFrame([], FOUND + ", rank int"))
    pairs = written(pairs)
    n = max(spark.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS))
    left = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns])
    both = pairs.join(left, "a_block").join(blocks, "block").repartition(n)
    found = both.mapInArrow(_looked_up(same, k), FOUND)
    order = Window.partitionBy("anchor_id", "ah", "p").orderBy(F.desc("score"), "vec_id", "vh")
    out = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    dropped(asked, pairs)
    return out


KEY = ["anchor_id", "ah"]


def _positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor_id, ah, positive_id, positive_score: the best k rows of the anchor's label with a score of 0 or more.
    Others have an empty window of negatives."""
    state = written(anchors.withColumn("t", F.floor(_norm2() / 2).cast("long")))
    kept, waste = [], []
    while True:
        found = _round(blocks, state, True, k)
        full = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("ah").alias("h")).agg(F.count(F.lit(1)).alias("full"))
        lower = F.floor(F.col("t") / 2)
        open_ = written(state.join(full, ["vec_id", "h"], "left").filter((F.coalesce("full", F.lit(0)) < k) & (F.col("t") > 0)).drop("full")
                        .withColumn("t", F.when(lower * 64 < _norm2(), F.lit(0)).otherwise(lower).cast("long")))
        kept.append(found.join(open_.select(F.col("vec_id").alias("anchor_id"), F.col("h").alias("ah")), KEY, "left_anti"))
        waste += [found, state]
        state = open_
        if state.isEmpty():
            break
    out = written(reduce(DataFrame.union, kept).select(*KEY, F.col("vec_id").alias("positive_id"), F.col("vh").alias("positive_h"), F.col("score").alias("positive_score")))
    dropped(*waste, state)
    return out


def _negatives(blocks: DataFrame, anchors: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """anchor_id, ah, p, vec_id, score, rank: the best k rows of other labels inside the window of each positive score p."""
    windows = positives.groupBy(*KEY).agg(F.sort_array(F.collect_set("positive_score")).alias("ps"))  # POSITIVES scores at most
    state = written(anchors.join(windows.withColumnsRenamed({"anchor_id": "vec_id", "ah": "h"}), ["vec_id", "h"])
                    .withColumn("t", F.ceil(F.col("ps")[0] * STEPS[0] / 100).cast("long")))
    kept, waste = [], []
    for step in [*STEPS[1:], None]:
        found = _round(blocks, state, False, k)
        if step is None:
            kept.append(found)
            waste += [found, state]
            break
        full = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("ah").alias("h"), F.col("p")).agg(F.count(F.lit(1)).alias("full"))
        each = state.select("vec_id", "h", F.col("t"), F.explode("ps").alias("p")).join(full, ["vec_id", "h", "p"], "left")
        short = each.filter((F.coalesce("full", F.lit(0)) < k) & (F.col("t") * 100 > F.col("p") * 30)).select("vec_id", "h").distinct()
        open_ = written(state.join(short, ["vec_id", "h"], "left_semi").withColumn("t", F.ceil(F.col("ps")[0] * step / 100).cast("long")))
        kept.append(found.join(open_.select(F.col("vec_id").alias("anchor_id"), F.col("h").alias("ah")), KEY, "left_anti"))
        waste += [found, state]
        state = open_
        if state.isEmpty():
            waste.append(state)
            break
    out = written(reduce(DataFrame.union, kept))
    dropped(*waste)
    return out


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``rows`` and ``anchors``: (vec_id, h, label, v) as ``usable`` gives them. Rows equal in all of these are one row;
    rows that share a vec_id alone are rows of their own, but never positives or negatives of that id's anchors.
    Vectors of different lengths are compared on the dimensions both have. Anchors without a positive of score 0 or
    more have no rows (their windows are empty), empty tables give none. Scores are exact while they stay below 2**53,
    beyond they are 64-bit sums.
    """
    blocks = _packed(rows, ROWS)
    anchors = written(anchors.dropDuplicates(["vec_id", "h"]))
    best = _positives(blocks, anchors, positives)
    found = _negatives(blocks, anchors, best, negatives)
    pairs = best.withColumn("p", F.col("positive_score")).join(found, [*KEY, "p"])
    dropped(blocks, anchors)
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, folder: str) -> DataFrame:
    """Every row whose vec_id is divisible by 100 is an anchor; a seventh of the rows first change their label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    rows = usable(rows)
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


SQL = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    windows AS (
      SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM windows WHERE rank <= 10"""
