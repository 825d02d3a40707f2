"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is a sum over all labelled documents: each task counts the hashed 1- to 3-grams of its texts by
language, Spark adds the counts up, and the table of (language, bucket) is bounded by its two sides. Its
logarithms, smoothed, are the matrix that goes to all tasks. A batch of texts is scored by gathering the
matrix rows of all n-grams at once and adding them up text by text: only the n-grams that occur are
touched. The language is the one with the greatest sum of log prior and log probabilities of all n-grams. Its
score is its posterior from the mean log probability of an n-gram times ``EVIDENCE``, as if a text had that many
independent n-grams at most; the evidence is scaled for the score alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.flat import mix, text_slices
from riffle.llm.shared import held_out, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
EVIDENCE = 100
#: Languages a model may tell apart; the matrix holds this many columns at most.
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
#: Letters, and numbers that are not digits, such as fractions.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def ngrams(texts: list[str], buckets: int = BUCKETS, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-case texts, grouped by text (white space is one blank, one at either
    end), and how many each text has."""
    # a zero stands between texts; n-grams across it are left out
    joined = "".join(f" {' '.join(t.replace(chr(0), ' ').lower().split())} \0" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    stops = points == 0
    of = np.cumsum(stops) - stops
    hashes, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    valid = np.ones(len(points), bool)
    for n in range(1, max(orders) + 1):
        last = len(points) - n + 1
        if last <= 0:
            break
        rolled = rolled[:last] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:n - 1 + last] + np.uint64(1)
        valid = valid[:last] & ~stops[n - 1:n - 1 + last]
        if n in orders:
            at = np.flatnonzero(valid)
            hashes.append((mix(rolled[at] + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64))
            owners.append(of[at])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(texts))


def _counted(names: list[str], buckets: int):
    def run(batches):
        place = {x: i for i, x in enumerate(names)}
        total, docs = np.zeros((len(names), buckets), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for part, texts in text_slices(batch, limit=1 << 19):
                langs = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                docs += np.bincount(langs, minlength=len(names))
                found, counts = ngrams(texts, buckets)
                total += np.bincount(np.repeat(langs, counts) * buckets + found, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([lang, np.arange(len(names))])), pa.array(np.concatenate([bucket, np.full(len(names), -1)])),
            pa.array(np.concatenate([total[lang, bucket], docs]))], names=["lang", "bucket", "n"])

    return run


def fitted(labelled: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (ascending), log prior and log probabilities (bucket x language) from all rows of
    ``labelled`` (text, lang) with a lang."""
    labelled = labelled.select("text", "lang").filter("lang is not null")
    names = sorted(r.lang for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts, docs = np.full((buckets, len(names)), smoothing), np.zeros(len(names))
    if names:
        rows = labelled.mapInArrow(_counted(names, buckets), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        for part in (rows.toArrow().to_batches()):  # bounded by languages x buckets
            lang, bucket, n = (part.column(c).to_numpy() for c in ("lang", "bucket", "n"))
            own = bucket >= 0
            counts[bucket[own], lang[own]] += n[own]
            docs[lang[~own]] += n[~own]
    return names, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), np.log(counts / counts.sum(axis=0)) if names else counts


def predicted(docs: DataFrame, model, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone. Null texts and texts without a
    letter are ``und`` with score 0; so is everything if nothing was learned. Ties: the language that
    sorts first. Repeated rows and null ids are rows like any other."""
    names, prior, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast((names, prior.astype(np.float32), matrix.astype(np.float32)))  # languages x buckets

    def run(batches):
        names, prior, matrix = sent.value
        for batch in batches:
            for part, texts in text_slices(batch, limit=1 << 19):
                found, counts = ngrams(texts, buckets)
                some = np.flatnonzero(counts) if names else np.zeros(0, np.int64)
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if len(some):
                    first = (np.cumsum(counts) - counts)[some]
                    sums = np.add.reduceat(np.take(matrix, found, axis=0), first, axis=0, dtype=np.float64)
                    top = (prior + sums).argmax(axis=1)
                    logs = prior + sums * (np.minimum(counts[some], EVIDENCE) / counts[some])[:, None]
                    post = 1 / np.exp(np.minimum(logs - logs[np.arange(len(top)), top][:, None], 700)).sum(axis=1)
                    for i, k, p in zip(some.tolist(), top.tolist(), post.tolist()):
                        if has_letter(texts[i]):
                            lang[i], score[i] = names[k], p
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fitted(docs.filter(~held_out(0, 5)))
    return predicted(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")
