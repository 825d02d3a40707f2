"""Repeated substrings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from riffle.llm.suffix_dedup import op3_suffix_dedup, remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """(doc_id, bytes, removed, runs, digest) per row, from a count of every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        reach = 0
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                for k in range(max(p, reach), p + length):
                    gone[k] = True
                reach = p + length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def made(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé") for _ in range(pick.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(n) for n in (20, 40, 90)]
    rows = []
    for i in range(60):
        parts = [text(pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passage)
            cut = pick.randint(0, len(p) // 2)
            parts += [p[cut:cut + pick.randint(10, len(p))], text(pick.randint(0, 12))]
        rows.append((i, "".join(parts)))
    rows += [(60, None), (61, ""), (62, "x" * 900), (63, "ab" * 300), (64, rows[3][1]), (5, rows[5][1]), (None, rows[7][1]),
             (None, text(80)), (7, text(70)), (65, " ".join([passage[2]] * 2))]
    return rows


@pytest.mark.parametrize("seed,length", [(1, 100), (2, 150), (3, 70), (4, 400)])
def test_against_all_windows(spark, seed, length):
    rows = made(seed)
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA), length)) == brute(rows, length)


def test_long_documents_are_cut_into_pieces_without_loss(spark):
    pick = random.Random(9)
    block = "".join(pick.choice("abcdefgh") for _ in range(700))
    filler = "".join(chr(97 + pick.getrandbits(4)) for _ in range(1_100_000))
    rows = [(1, filler[:1_048_300] + block + filler[1_048_300:]), (2, "start " + block)]
    first, second = sorted(got(remove_repeats(spark.createDataFrame(rows, SCHEMA))))
    assert (first[2], first[3]) == (700, 1) and (second[2], second[3]) == (700, 1)


def test_empty_table_and_clashing_columns(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "q" * 500, 7, "z")], "doc_id long, text string, th int, data string")
    assert got(remove_repeats(df)) == brute([(1, "q" * 500)], 400)


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op3_suffix_dedup(spark, folder)) == brute(rows, 400)
