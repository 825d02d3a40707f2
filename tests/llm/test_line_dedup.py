"""Line deduplication against all pairs."""

import difflib
import random

import pytest

from riffle.llm.line_dedup import common_blocks, longest_block, op2_line_dedup, patience, remaining_lines, without_repeated_lines

SCHEMA = "doc_id long, text string"


def brute(rows, min_words):
    """(doc_id, lines, removed) by aligning every document with every earlier one."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (key(r), r[1]))
    gone = {}
    for n, (i, t) in enumerate(docs):
        lines = t.split("\n")
        code = lambda ls: [x if x.split() else 0 for x in ls]
        lost = set()
        for _, u in docs[:n]:
            if code(u.split("\n")) == code(lines):
                if sum(len(x.split()) for x in lines) >= min_words:
                    lost |= set(range(len(lines)))
            else:
                lost |= set(common_blocks(code(u.split("\n")), code(lines), [len(x.split()) for x in lines], min_words))
        worded = [k for k, x in enumerate(lines) if x.split()]
        lost |= {k for k, x in enumerate(lines) if not x.split() and any(w < k for w in worded) and any(w > k for w in worded)
                 and max(w for w in worded if w < k) in lost and min(w for w in worded if w > k) in lost}
        gone[(i, t)] = (i, len(lines), len(lost), "\n".join(x for k, x in enumerate(lines) if k not in lost))
    return sorted((gone[(i, t or "")] for i, t in rows), key=repr)


def made(seed):
    pick = random.Random(seed)
    line = lambda: " ".join(f"w{pick.randint(0, 500)}" for _ in range(pick.randint(1, 14)))
    blocks = [[line() for _ in range(pick.randint(1, 5))] for _ in range(6)]
    rows = []
    for i in range(40):
        out = [line() for _ in range(pick.randint(0, 4))]
        for b in sorted(pick.sample(range(6), pick.randint(0, 2))):  # blocks in one order: every alignment finds them
            out += blocks[b] + [line() for _ in range(pick.randint(0, 3))] + [""] * pick.randint(0, 1)
        rows.append((i, "\n".join(out)))
    return rows + [(40, None), (41, ""), (42, "\n\n"), (43, rows[3][1]), (5, rows[5][1]), (None, rows[7][1]), (44, "short line"), (45, "short line")]


@pytest.mark.parametrize("seed,rare", [(1, 1000), (2, 1000), (3, 3), (4, 0)])
def test_against_all_pairs(spark, seed, rare):
    rows = made(seed)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in remaining_lines(spark.createDataFrame(rows, SCHEMA), min_words=10, rare=rare).collect()), key=repr)
    assert got == brute(rows, 10)


def test_patience_alignment_is_common_and_ordered():
    pick = random.Random(7)
    for _ in range(200):
        a, b = ([pick.randint(0, 12) for _ in range(pick.randint(0, 30))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a = list(range(1, 40))
    b = [100, *a[:10], 101, *a[10:30], 102, *a[32:]]
    want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert len(patience(a, b)) == want


def test_filter_keeps_columns_and_null_texts(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"{long}\nmine", 9, "a"), (2, f"{long}\nother words", 9, "b"), (3, None, 9, "c"), (4, long, 9, "d"), (5, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, whole string")
    left = {r.doc_id: (r.text, r.n_chars, r.whole) for r in without_repeated_lines(df).collect()}
    assert left == {1: (f"{long}\nmine", 9, "a"), 2: ("other words", 11, "b"), 3: (None, 9, "c"), 5: ("", 0, "e")}
    assert without_repeated_lines(df).columns == df.columns
    assert remaining_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_small_table(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 10)]
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in op2_line_dedup(spark, folder).collect()) == sorted(want)


@pytest.mark.parametrize("rare", [0, 5])
def test_frequent_runs_beyond_the_earliest_holder(spark, rare):
    x, y, z = ([f"{c}{i} " + " ".join(f"{c}{i}w{k}" for k in range(11)) for i in range(2)] for c in "xyz")
    rows = [(0, [*y, "a0", *x, "b0", z[0], "c0", z[0]])]  # y and x in crossed order, z twice
    rows += [(i, [f"a{i}", *x, f"b{i}", *y, f"c{i}", z[0], f"d{i}"]) for i in range(1, 9)]
    rows += [(9, [*z, "a9", *y, "b9", *x]), (10, ["a10", *x, "b10", *x, "c10", *y]), (11, [*x, "a11", *x, "b11", *y])]
    rows = [(i, "\n".join(t)) for i, t in rows]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in remaining_lines(spark.createDataFrame(rows, SCHEMA), rare=rare).collect()), key=repr)
    assert got == brute(rows, 10)
    left = {i: t for i, _, _, t in got}
    assert all(left[i] == f"a{i}\nb{i}\nc{i}\nd{i}" for i in range(2, 9))


@pytest.mark.parametrize("seed", [11, 12])
def test_blocks_in_any_order_against_all_pairs(spark, seed):
    pick = random.Random(seed)
    blocks = [[f"{b} {i} " + " ".join("abcdefgh") for i in range(pick.randint(1, 3))] for b in range(4)]
    rows = []
    for i in range(60):
        out = [f"own {i}"]
        for n, b in enumerate(pick.choices(range(4), k=pick.randint(1, 4))):
            out += [*blocks[b], f"own {i} {n}"]
        rows.append((i, "\n".join(out)))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in remaining_lines(spark.createDataFrame(rows, SCHEMA), rare=0).collect()), key=repr)
    assert got == brute(rows, 10)


def test_blocks_that_repeat_inside_a_document_against_difflib():
    blocks = lambda a, b, least: sorted(j for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least for j in range(m.b, m.b + m.size))
    pick = random.Random(5)
    for _ in range(300):
        a, b = ([pick.randint(1, 4) for _ in range(pick.randint(1, 30))] for _ in range(2))
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert longest_block(a, b) == ((m.a, m.b, m.size) if m.size else (0, 0, 0))
    again = [1, 2, 3]
    for a, b in [
        ([10, *again, 11, *again, 12], [20, *again, 21]),  # twice in the earlier document
        ([10, *again, 11], [20, *again, 21, *again, 22]),  # twice in the later one
        ([10, *again, 11, *again, 12], [20, *again, 21, *again, 22]),
    ]:
        assert common_blocks(a, b, [5] * len(b), 10) == blocks(a, b, 2) != []
    # 7 stands once in either, so it parts the two gaps: one passage on each side
    assert common_blocks([10, *again, *again, 11, 7, 12, *again, 13], [20, *again, 21, 7, 22, *again, *again, 23], [5] * 14, 10) == [1, 2, 3, 7, 8, 9]
    assert patience([1, 0, 9, 0, 9, 2], [3, 0, 8, 0, 8, 4]) == []
    assert len(patience([8, *[1, 2] * 20000, 9], [7, *[1, 2] * 19000, 6])) == 38000


def test_a_rare_pair_with_a_repeated_passage(spark):
    line = "the passage that stands twice in either text has ten words"
    rows = [(0, f"a\n{line}\nb\n{line}\nc"), (1, f"d\n{line}\ne\n{line}\nf")]
    left = {r.doc_id: r.text for r in remaining_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert left == {0: rows[0][1], 1: "d\ne\nf"}
