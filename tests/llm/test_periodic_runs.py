"""Periodic runs against a dense table of diagonals."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm.periodic_runs import op12_periodic_runs, periodic_runs, planted_repeats, runs_of

SMALL = "/root/testdata/sf0.001"


def slow_runs(words, least=12):
    """Every diagonal of every lag, word by word; of equal stretches the least period."""
    best = {}
    for q in range(1, len(words)):
        m = 0
        for i in range(q, len(words) + 1):
            if i < len(words) and words[i] == words[i - q]:
                m += 1
                continue
            if m >= q and m + q >= least:
                best.setdefault((i - m - q, m + q), q)
            m = 0
    return sorted((s, n, q) for (s, n), q in best.items())


def slow_row(doc_id, text, change=None):
    words = [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    if change and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_many_texts_at_once(seed):
    pick = random.Random(seed)
    for _ in range(60):
        docs = []
        for _ in range(pick.randint(1, 4)):
            w = [pick.randrange(pick.choice([1, 2, 3, 20])) for _ in range(pick.randint(0, 80))]
            for _ in range(pick.randint(0, 3)):
                i, p = pick.randrange(len(w) + 1), pick.randint(1, 14)
                for j in range(i + p, min(len(w), i + pick.randint(p, 60))):
                    w[j] = w[j - p]
            docs.append(w)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start, end, lag = runs_of(np.array(sum(docs, []), np.int64), owner)
        got, base = [], 0
        for d in docs:
            own = (start >= base) & (start < base + len(d))
            got.append(list(zip((start[own] - base).tolist(), (end - start + 1)[own].tolist(), lag[own].tolist())))
            base += len(d)
        assert [sorted(x) for x in got] == [slow_runs(d) for d in docs]


def test_hard_texts_take_about_linear_time():
    n = 200_000
    log = np.tile(np.arange(9), n // 9)
    log[8::9] = np.arange(len(log[8::9])) + 100
    thue = np.array([bin(i).count("1") & 1 for i in range(n)])
    begun = time.time()
    for words, want in ((np.zeros(n, int), [(0, n - 1, 1)]), (np.arange(n) % 7, [(0, n - 1, 7)]), (np.arange(n) % 70_000, [(0, n - 1, 70_000)]), (log, []), (thue, None)):
        got = list(zip(*(x.tolist() for x in runs_of(words, np.zeros(len(words), np.int64)))))
        assert want is None or got == want
    assert time.time() - begun < 60


def test_defined_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (4, "a " * 12), (4, "a " * 12), (None, f"{ten} {ten} end"), (5, "é x  " * 12),
            (6, "x y " * 5 + "x"), (7, "x y " * 6 + "z " + "x y " * 6), (-8, "word " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_runs", F.lit("z")).withColumn("start", F.lit(2))
    got = periodic_runs(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].n_runs == 0 and by[i][0].start is None and by[i][0].collapsed == "" for i in (1, 2, 3))
    assert sorted((r.n_runs, r.collapsed) for r in by[4]) == [(0, " ".join("a" * 11)), (1, "a"), (1, "a")]
    assert (by[None][0].start, by[None][0].length, by[None][0].period, by[None][0].collapsed) == (0, 20, 10, f"{ten} end")
    assert by[5][0].length == 12 and by[5][0].collapsed == "é x "
    assert by[6][0].n_runs == 0
    assert [(r.start, r.length, r.period) for r in by[7][0].runs] == [(0, 12, 2), (13, 12, 2)] and by[7][0].start == 0
    assert (by[-8][0].length, by[-8][0].period, by[-8][0].collapsed) == (1_000_000, 1, "word")
    assert periodic_runs(df.limit(0)).count() == 0


def test_planted_repeats():
    assert planted_repeats(None, 9) is None
    some = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert planted_repeats(some, 0) is None and len(planted_repeats(some, 50)) == 50


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {tuple(r) for r in op12_periodic_runs(spark, SMALL).collect()}
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(got) == len(docs) and {slow_row(r.doc_id, r.text, True) for r in short} <= got
