"""Near-duplicate classes against all pairs; darts against exact similarities."""

import random

import numpy as np
import pytest

from riffle.llm.near_duplicates import (
    band_hashes, dart_signatures, near_duplicates, op6_near_duplicates, shingles, similarity, weighted, without_near_duplicates)

SCHEMA = "doc_id long, text string"


def brute(rows, least=0.8):
    """Components of all pairs of similarity 0.8 on word shingles, as the set of groups of row places."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups


def expected(rows):
    out = []
    for group in brute(rows).values():
        ids = [rows[i][0] for i in group]
        top = None if None in ids else min(ids)
        out += [(i, top, len(ids)) for i in ids]
    return sorted(out, key=repr)


def made(seed, groups=12):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7)))
    rows, at = [], 0
    for _ in range(groups):
        base = [word() for _ in range(pick.randint(3, 300))]
        for _ in range(pick.randint(1, 6)):
            copy = [word() if pick.random() < pick.choice([0, 0.01, 0.03, 0.3]) else w for w in base]
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n\t "), (at + 3, "one two"), (at + 4, "One  TWO"), (3, rows[3][1]), (None, rows[5][1]),
             (None, "alone in the world with words of its own"), (at + 5, "x " * 4000), (at + 6, "x " * 3999)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_pairs(spark, seed):
    rows = made(seed)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.cluster_id, r.cluster_size) for r in found), key=repr) == expected(rows)
    assert sum(r.kept for r in found) == len(brute(rows))
    assert all(r.n_links > 0 for r in found if r.kept is False and r.n_links) and len(found) == len(rows)


def test_a_group_whose_copies_are_like_their_source_only(spark):
    """Each copy is over 0.8 to the source but not to other copies: the class must still be one."""
    pick = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if pick.random() > 0.016 else f"z{pick.random()}" for w in base)) for i in range(120)] + [(500, " ".join(base))]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.cluster_id, r.cluster_size) for r in found), key=repr) == expected(rows)


def test_without_near_duplicates_keeps_rows_and_columns(spark):
    rows = [(1, "a b c d e f g", 5, "x"), (1, "a b c d e f g", 5, "x"), (2, "A b c d e f g", 6, "y"), (3, None, 7, "z"), (3, None, 7, "z"), (4, "other words", 8, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, th string")
    left = sorted((r.doc_id, r.th) for r in without_near_duplicates(df).collect())
    assert left == [(1, "x"), (3, "z"), (3, "z"), (4, "w")] and without_near_duplicates(df).columns == df.columns
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("weight", ["set", "count", "log"])
def test_share_of_equal_coordinates_is_the_weighted_similarity(weight):
    pick = random.Random(3)
    words = [f"t{pick.randint(0, 400)}" for _ in range(600)]
    a, b = " ".join(words), " ".join(words[:480] + ["u"] * 20 + words[500:])
    (xa, wa), (xb, wb) = (weighted(x, weight) for x in shingles([a.encode(), b.encode()]))
    sig = dart_signatures([(xa, wa), (xb, wb)], 2000)
    both = dict(zip(xa.tolist(), wa)), dict(zip(xb.tolist(), wb))
    keys = set(both[0]) | set(both[1])
    exact = sum(min(both[0].get(k, 0), both[1].get(k, 0)) for k in keys) / sum(max(both[0].get(k, 0), both[1].get(k, 0)) for k in keys)
    assert abs(similarity(xa, xb, wa, wb) - exact) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    assert band_hashes(sig, 400, 5).shape == (2, 400)


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"a b c d e f", b"", b"a b", b"a b c d e f", b"x"]
    whole = shingles(texts)
    for t, s in zip(texts, whole):
        assert np.array_equal(shingles([t])[0], s)
    assert [len(s) for s in whole] == [2, 0, 1, 2, 1]


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.cluster_id, r.cluster_size) for r in op6_near_duplicates(spark, folder).collect()), key=repr) == expected(rows)
