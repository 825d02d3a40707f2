"""Hard negatives: the pruned kernel against the plain product, the operator against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm.hard_negatives import hard_negatives, op11_hard_negatives, reached, usable

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(60))
def test_kernel_loses_no_pair(seed):
    pick = np.random.default_rng(seed)
    d = int(pick.integers(1, 70))
    x, y = pick.integers(-200, 200, (int(pick.integers(1, 130)), d)), pick.integers(-200, 200, (int(pick.integers(1, 200)), d))
    if seed % 3 == 0:
        x, y = x * (pick.random(x.shape) < 0.3), y * (pick.random(y.shape) < 0.2)
    if seed % 5 == 0:
        y = (y * np.exp(-np.arange(d) / 4)).astype(int)
    if seed % 11 == 0:
        x, y = x << 20, y << 20
    s = x @ y.T
    t = np.maximum(seed % 7 == 0, np.quantile(s, pick.choice([0.2, 0.5, 0.9, 0.99, 1.0]), axis=1).astype(int))
    t = np.minimum(t, s.max(axis=1)) if seed % 11 == 0 else t
    t = np.maximum(t, 0)
    q, r, score = reached(x, t, y)
    assert sorted(zip(q.tolist(), r.tolist())) == sorted(zip(*(c.tolist() for c in np.nonzero(s >= t[:, None])))) and (s[q, r] == score).all()


def slow(rows, anchors_every, positives=5, negatives=10):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a, la, va in ok:
        if a % anchors_every:
            continue
        near = sorted((-sum(p * q for p, q in zip(va, v)), i, label != la) for i, label, v in ok if i != a)
        for ps, p, _ in [x for x in near if not x[2]][:positives]:
            inside = [x for x in near if x[2] and -30 * ps <= -100 * x[0] <= -90 * ps]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "copies", "sparse"])
def test_operator(spark, kind):
    pick = random.Random(kind)
    rows = []
    for i in range(240):
        v = [pick.gauss(0, 0.2) for _ in range(12)]
        if kind == "copies" and i % 3:
            v = [0.3, -0.1, 0.2] + [0.0] * 9 if i % 2 else [0.25, -0.1, 0.2] + [0.01] * 9
        if kind == "sparse":
            v = [x if pick.random() < 0.15 else 0.0 for x in v][:pick.randint(0, 12)]
        rows.append((i, v, pick.randrange(2 if kind == "copies" else 6)))
    rows += [(500, None, 1), (510, [0.1], None), (520, [float("nan")], 1), (530, [float("inf"), 0.1], 1), (540, [None, 0.1], 1), (None, [0.1], 1), (550, [], 1), (560, [0.5], 77), *rows[:20], (20, [0.1] * 12, 3), (570, [-0.5] * 12, 78), (571, [0.5] * 12, 78)]
    df = spark.createDataFrame(rows, KIND).withColumn("h", F.lit("z")).withColumn("t", F.lit(1)).withColumn("p", F.lit(2))
    good = usable(df)
    got = sorted(tuple(r) for r in hard_negatives(good, good.filter("vec_id % 10 = 0")).collect())
    assert got == slow(rows, 10) and (kind == "sparse" or got)


def test_empty(spark):
    none = usable(spark.createDataFrame([], KIND))
    assert hard_negatives(none, none).count() == 0
    one = usable(spark.createDataFrame([(0, [0.5], 1)], KIND))
    assert hard_negatives(one, one).count() == 0 and hard_negatives(one, none).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, SMALL).collect()) == slow(rows, 100)
