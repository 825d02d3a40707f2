"""Quality classifier: naive Bayes support vectors over hashed word n-grams.

Features are indicators of single tokens and pairs of neighbours, and of a token that follows itself;
tokens are runs of letters and digits or of other signs, case kept. Over the labelled rows (``LABELLED_ROWS``
at most, about, by hash of the id: a bound that lets their ids be broadcast to the texts) Spark sums how many good and bad documents have each feature; the log ratio of the two smoothed shares scales the
indicators. On the scaled indicators, divided by the root of their number, a linear model is fitted to
hinge loss by dual coordinate descent: one dual variable per document, moved to its optimum in turn, the
weights kept up to date. The descent is sequential, so it runs on a bounded sample of the labelled rows
(``FIT_ROWS``, about, by hash of the id). A part of the sample is left out
of the descent and fits the logistic curve that turns margins into scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.flat import BLANK, chunks, mix, text_slices, words_of
from riffle.llm.shared import dropped, held_out, table, text_hash, written

BUCKETS = 1 << 18
FIT_ROWS = 12_000
#: Label rows that training reads at most, about.
LABELLED_ROWS = 100_000
SMOOTHING = 1.0
COST = 1.0
PASSES = 20
#: Kind of each byte: 0 white space, 1 letters, digits and all of other scripts, 2 other signs.
KINDS = np.where(BLANK, 0, 2).astype(np.uint8)
KINDS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1


def features(texts: list[str], buckets: int = BUCKETS) -> list[np.ndarray]:
    """Ascending distinct features of each text."""
    out = []
    texts = [t.encode() for t in texts]
    for s, e in chunks(texts):
        one, bounds = words_of(texts[s:e], KINDS)
        two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) if len(one) > 1 else one[:0]
        again = one[1:] == one[:-1]
        two[again] = mix(np.ones(int(again.sum()), np.uint64))
        mask = np.uint64(buckets - 1)
        one, two = (one & mask).astype(np.uint32), (two & mask).astype(np.uint32)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out.append(np.unique(np.concatenate([one[lo:hi], two[lo:max(lo, hi - 1)]])))
    return out


def _featured(buckets: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([
                    part.column("pick"), part.column("label"), pa.array([f.tobytes() for f in features(texts, buckets)], pa.binary())], names=["pick", "label", "features"])

    return run


def _counted(buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for label in (0, 1):
                own = [np.frombuffer(f.as_buffer(), np.uint32) for f, x in zip(batch.column("features"), labels) if x == label]
                if own:
                    total[label] += np.bincount(np.concatenate(own), minlength=buckets)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "bad", "good"])

    return run


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """Weights of the linear hinge-loss model over rows of scaled indicators. The last weight is the bias."""
    weights = np.zeros(len(scale) + 1)
    dual = np.zeros(len(rows))
    root = np.sqrt(np.maximum(1, np.fromiter(map(len, rows), np.int64, len(rows))))
    scale2 = scale * scale  # scaled rows are made when their turn comes: only the indicators are held
    square = np.array([scale2[r].sum() for r in rows]) / root**2 + 1.0
    order = np.arange(len(rows))
    pick = np.random.default_rng(seed)
    for _ in range(passes):
        pick.shuffle(order)
        moved = 0.0
        for i in order:
            r, y = rows[i], signs[i]
            v = scale[r] / root[i]
            slope = y * (weights[r] @ v + weights[-1]) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            if (step := new - dual[i]) != 0.0:
                dual[i] = new
                weights[r] += step * y * v
                weights[-1] += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the greatest likelihood, by Newton steps, with targets
    drawn in a little from 0 and 1; the slope is never negative."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([g @ margins + 1e-3 * a, g.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def _sampled(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features (views of one array) and labels of some rows, in the order of pick and features."""
    got = rows.select("pick", "label", "features").toArrow()
    packed = got.column("features").combine_chunks()
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, np.int32)[packed.offset:packed.offset + len(packed) + 1] // 4
    flat = np.frombuffer(data, np.uint32).copy() if data is not None else np.zeros(0, np.uint32)
    pick, labels = got.column("pick").to_numpy(), got.column("label").to_numpy()
    found = [flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
    _, at, times = np.unique(pick, return_inverse=True, return_counts=True)
    order = sorted(range(len(found)), key=lambda i: (int(pick[i]), found[i].tobytes() if times[at[i]] > 1 else b""))
    return [found[i] for i in order], labels[order]


def fitted(labelled: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, cost: float = COST):
    """(weights of the features, bias, slope, offset) from rows of (doc_id, text, label), label 0 or 1;
    other labels and null are left out. With one label only, or none, everything scores its share."""
    rows = labelled.filter(F.col("label").isin(0, 1)).select(
        F.pmod(F.xxhash64(F.lit(7), "doc_id", text_hash()), F.lit(1 << 30)).alias("pick"), F.col("label").cast("int").alias("label"), "text")
    kept = written(rows.mapInArrow(_featured(buckets), "pick long, label int, features binary"))
    sizes = {r.label: r.n for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        dropped(kept)
        share = (sizes.get(1, 0) + 1) / (total + 2)
        return np.zeros(buckets, np.float32), 0.0, 1.0, float(np.log(share / (1 - share)))
    counts = np.full((2, buckets), SMOOTHING)
    sums = kept.mapInArrow(_counted(buckets), "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    for part in sums.toArrow().to_batches():  # at most a row for each bucket
        at = part.column("feature").to_numpy()
        counts[0, at] += part.column("bad").to_numpy()
        counts[1, at] += part.column("good").to_numpy()
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    limit = int((1 << 30) * min(1.0, fit_rows / total))
    found, labels = _sampled(kept.filter(F.col("pick") < limit))  # about fit_rows rows
    dropped(kept)
    aside = np.arange(len(labels)) % 4 == 3
    use = np.flatnonzero(~aside) if len(set(labels[aside])) == len(set(labels[~aside])) == 2 else np.arange(len(labels))
    weights = dual_descent([found[i] for i in use], ratio, np.where(labels[use] == 1, 1.0, -1.0), cost)
    vector = weights[:-1] * ratio
    test = np.flatnonzero(aside) if len(use) < len(labels) else use
    margins = np.array([vector[found[i]].sum() / max(1.0, np.sqrt(len(found[i]))) for i in test]) + weights[-1]
    del found
    pa.default_memory_pool().release_unused()
    return vector.astype(np.float32), float(weights[-1]), *curve(margins, labels[test].astype(float))


def _scores(texts: list[str], model) -> np.ndarray:
    vector, bias, slope, offset = model
    sums = np.array([vector[f].sum(dtype=np.float64) / max(1.0, np.sqrt(len(f))) for f in features(texts, len(vector))])
    return 1 / (1 + np.exp(-np.clip(slope * (sums + bias) + offset, -700, 700)))


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id, th, score (0 to 1) and predicted (1 from 0.5) of every row, from its text alone. Null and
    empty texts have no feature and score what the bias alone says."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                score = _scores(texts, sent.value)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("th"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "th", "score", "predicted"])

    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, score double, predicted int")


def trained_on(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS):
    """The model from the rows of ``docs`` whose ids ``labels`` (doc_id, quality) marks, without the
    held-out ones. A document with several label rows counts once for each. Of more than
    ``labelled_rows`` label rows, about that many are taken, by hash of the id."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("label"))
    marks = marks.filter(F.col("__id").isNotNull() & F.col("label").isNotNull() & ~held_out(1, 3, "__id"))
    n = marks.count()
    if n > labelled_rows:
        marks = marks.filter(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1 << 30)) < int((1 << 30) * labelled_rows / n))
    # about labelled_rows rows of two numbers: bounded, so no text is shuffled
    return fitted(docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("__id")))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows and columns without the documents that the classifier rejects."""
    model = trained_on(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(_scores(texts, sent.value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = trained_on(docs, table(spark, folder, "labels"))
    return scored(docs, model).select("doc_id", held_out(1, 3).alias("held_out"), "score", "predicted")
