"""Line deduplication by pairwise alignment.

A *run* is the shortest stretch of lines from a given line on, or up to it, that holds ``min_words``
words. Every line of a common block with that many words lies in a run inside the block, so two documents
have a common block only if they share a run. Runs are hashed, and documents that share one are paired:
all pairs if the run is rare (in ``rare`` documents at most), otherwise each document with the earliest
one that has the run, and then, as long as a line of the run is left in the document, in rounds with the
next 4, 16, 64 and so on that have it, until the run is gone or no earlier holder is left. So the lines that
go are those of an alignment with every earlier document, whatever ``rare`` is. The number of pairs grows
with the number of lines times that of the arrangements (order and count of the frequent runs) that
documents have, as a document looks no further than the first holders arranged like it.

Pairs are aligned by patience diff over line hashes: equal lines at both ends are matched, then lines
that occur once on either side, in the longest order common to both, or, where no line does, the longest
common block; the gaps between are treated in the same way. Matched lines that follow one another on both sides form a block, and blocks of ``min_words``
words or more go from the later document, with blank lines inside what goes. Texts of equal lines are one class; all but its earliest
document lose every line. Earlier means: lesser doc_id, then lesser hash of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.flat import text_slices
from riffle.llm.shared import dropped, keyed, table, text_hash, written

MIN_WORDS = 10
RARE = 5


def longest_block(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the common block with the most lines with a word, the first of
    them in a, then in b. A suffix automaton of b reads a, so time grows with the lines, however often
    they repeat."""
    if not (set(a) & set(b)) - {0}:
        return 0, 0, 0
    after: list[dict[int, int]] = [{}]
    length, link, first = [0], [-1], [-1]  # of each state; first: where in b its stretches end first
    tip = 0
    for j, x in enumerate(b):
        new = len(after)
        after.append({})
        length.append(length[tip] + 1)
        link.append(0)
        first.append(j)
        p, tip = tip, new
        while p >= 0 and x not in after[p]:
            after[p][x] = new
            p = link[p]
        if p < 0:
            continue
        q = after[p][x]
        if length[q] != length[p] + 1:
            own = len(after)
            after.append(dict(after[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            first.append(first[q])
            link[q] = own
            while p >= 0 and after[p].get(x) == q:
                after[p][x] = own
                p = link[p]
            q = own
        link[new] = q
    upto = [0]
    for x in a:
        upto.append(upto[-1] + (x != 0))
    best, most = (0, 0, 0), 0
    state = n = 0
    for i, x in enumerate(a):
        while state and x not in after[state]:
            state = link[state]
            n = length[state]
        if x in after[state]:
            state = after[state][x]
            n += 1
        worded = upto[i + 1] - upto[i + 1 - n]
        if worded > most:
            best, most = (i + 1 - n, first[state] + 1 - n, n), worded
    return best


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned places, ascending in both. Value 0 (a line without a word) only joins others."""
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        ours, theirs = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {x: j for j, x in enumerate(b[blo:bhi], blo) if x and theirs[x] == 1}
        anchors = [(i, at[x]) for i, x in enumerate(a[alo:ahi], alo) if x in at and ours[x] == 1]
        if not anchors:
            i, j, n = longest_block(a[alo:ahi], b[blo:bhi])
            if n:
                i, j = alo + i, blo + j
                found += zip(range(i, i + n), range(j, j + n))
                todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            continue
        ends: list[int] = []  # the longest ascending chain of places in b
        last: list[int] = []
        back = []
        for k, (_, j) in enumerate(anchors):
            p = bisect_left(ends, j)
            back.append(last[p - 1] if p else -1)
            ends[p:p + 1] = [j]
            last[p:p + 1] = [k]
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        before = (alo, blo)
        for i, j in reversed(chain):
            found.append((i, j))
            todo.append((before[0], i, before[1], j))
            before = (i + 1, j + 1)
        todo.append((before[0], ahi, before[1], bhi))
    return sorted(found)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines with words of ``b`` in aligned blocks of at least ``min_words`` words; ``words``: of each
    line of b."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*patience(a, b), (-1, -1)]:
        if before != (i - 1, j - 1):
            if sum(words[x] for x in block) >= min_words:
                out += [x for x in block if words[x]]
            block = []
        block.append(j)
        before = (i, j)
    return out


def _lined(batches):
    for batch in batches:
        for part, texts in text_slices(batch):
            hashes, counts, whole, total = [], [], [], []
            for text in texts:
                lines = text.split("\n")
                n = [len(x.encode().split()) for x in lines]
                h = np.array([xxhash.xxh3_64_intdigest(x.encode()) | 1 if k else 0 for x, k in zip(lines, n)], np.uint64).tobytes()
                hashes.append(h)
                counts.append(np.array(n, np.int32).tobytes())
                whole.append(xxhash.xxh3_128_digest(h))
                total.append(sum(n))
            keys = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("th"), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()),
                pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(total, pa.int64())],
                names=["doc_id", "th", "hashes", "counts", "w1", "w2", "words"])


def spans_of(counts: np.ndarray, min_words: int) -> set[tuple[int, int]]:
    """The shortest stretches with enough words from each line with a word on, and up to it."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    worded = np.flatnonzero(counts)
    ends = np.searchsorted(upto, upto[worded] + min_words)
    starts = np.searchsorted(upto, upto[worded + 1] - min_words, "right") - 1
    spans = {(i, e) for i, e in zip(worded.tolist(), ends.tolist()) if e <= len(counts)}
    return spans | {(s, i + 1) for i, s in zip(worded.tolist(), starts.tolist()) if s >= 0}


def runs_of(hashes: np.ndarray, spans: set[tuple[int, int]]) -> set[int]:
    view = memoryview(hashes.tobytes())
    return {xxhash.xxh3_64_intdigest(view[8 * s:8 * e]) for s, e in spans}


def _running(min_words: int):
    def run(batches):
        for batch in batches:
            ids, found = [], []
            for rid, h, c in zip(batch.column("rid").to_pylist(), batch.column("hashes"), batch.column("counts")):
                own = runs_of(np.frombuffer(h.as_buffer(), np.uint64), spans_of(np.frombuffer(c.as_buffer(), np.int32), min_words))
                ids += [rid] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(found, np.uint64).view(np.int64))], names=["rid", "run"])

    return run


def _left(min_words: int):
    """Of the runs asked for, those with a line that no alignment has taken, at any place they stand."""
    def run(batches):
        for batch in batches:
            ids, found = [], []
            for rid, h, c, asked, gone in zip(batch.column("rid").to_pylist(), batch.column("hashes"), batch.column("counts"), batch.column("asked"), batch.column("gone")):
                n = np.frombuffer(c.as_buffer(), np.int32)
                stays = n > 0
                for g in gone.as_py() or []:
                    stays[np.frombuffer(g, np.int32)] = False
                if not stays.any():
                    continue
                upto = np.concatenate([[0], np.cumsum(stays)])
                own = runs_of(np.frombuffer(h.as_buffer(), np.uint64), {(s, e) for s, e in spans_of(n, min_words) if upto[e] > upto[s]})
                own = np.intersect1d(np.array(list(own), np.uint64).view(np.int64), asked.values.to_numpy())
                ids += [rid] * len(own)
                found += own.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["rid", "run"])

    return run


def _placed(held: DataFrame) -> DataFrame:
    """``held`` with place: rows numbered from 0 in the order of run and document, a run over many tasks."""
    at = F.monotonically_increasing_id()
    rows = written(held.select("run", "rid", "one").orderBy("run", "one").withColumn("at", at))
    part = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row for each task
    upto, before = [], 0
    for r in sizes:
        upto.append((r["part"], before))
        before += r["count"]
    starts = held.sparkSession.createDataFrame(upto, "part long, before long")
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    out = written(placed.select("run", "rid", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place")))
    dropped(rows)
    return out


def _aligned(min_words: int):
    def run(batches):
        for batch in batches:
            ids, gone = [], []
            for rid, ha, hb, cb in zip(batch.column("later").to_pylist(), batch.column("ha"), batch.column("hb"), batch.column("cb")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64).tolist() for x in (ha, hb))
                lines = common_blocks(a, b, np.frombuffer(cb.as_buffer(), np.int32).tolist(), min_words)
                if lines:
                    ids.append(rid)
                    gone.append(np.array(lines, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.binary())], names=["rid", "gone"])

    return run


def _joined(batches):
    """One list from all lists of lines, with the blank lines between two lines of it."""
    for batch in batches:
        out = []
        for gone, counts in zip(batch.column("gone"), batch.column("counts")):
            n = np.frombuffer(counts.as_buffer(), np.int32)
            away = np.zeros(len(n), bool)
            for g in gone:
                away[np.frombuffer(g.as_buffer(), np.int32)] = True
            worded = np.flatnonzero(n)
            before = np.searchsorted(worded, np.arange(len(n)), "right") - 1
            after = np.searchsorted(worded, np.arange(len(n)))
            inner = (n == 0) & (before >= 0) & (after < len(worded))
            inner[inner] = away[worded[before[inner]]] & away[worded[after[inner]]]
            out.append(np.flatnonzero(away | inner).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, th (the text's hash), whole (all lines go) and gone (else: the numbers of those that go, from
    0) for every document that loses lines.

    Null texts are empty; rows equal in id and text are one document, and neither is the later one; null
    ids come first; documents below ``min_words`` words lose nothing; an empty table gives no rows.
    """
    lines = written(keyed(docs, "text").mapInArrow(_lined, "doc_id long, th long, hashes binary, counts binary, w1 long, w2 long, words long"))
    key = F.struct("doc_id", "th")
    enough = lines.filter(F.col("words") >= min_words)
    reps = enough.groupBy("w1", "w2").agg(F.min(key).alias("one")).withColumn("rid", F.monotonically_increasing_id())
    reps = written(reps)
    same = (F.col("l.w1") == F.col("r.w1")) & (F.col("l.w2") == F.col("r.w2"))
    joined = enough.alias("l").join(reps.alias("r"), same)
    copies = joined.filter(~F.struct("l.doc_id", "l.th").eqNullSafe(F.col("r.one"))).select(
        "l.doc_id", "l.th", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("gone")).distinct()
    own = written(joined.filter(F.struct("l.doc_id", "l.th").eqNullSafe(F.col("r.one"))).select("rid", "one", "hashes", "counts").dropDuplicates(["rid"]))
    runs = written(own.mapInArrow(_running(min_words), "rid long, run long").join(own.select("rid", "one"), "rid"))
    holders = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("one", "rid")).alias("first")).filter("n > 1")
    held = written(runs.join(holders, "run"))
    often = held.filter((F.col("n") > rare) & (F.col("rid") != F.col("first.rid"))).select(F.col("rid").alias("later"), F.col("first.rid").alias("earlier"))
    few = held.filter(F.col("n") <= rare).select("run", "rid", "one")
    pairs = few.alias("x").join(few.alias("y"), "run").filter(F.col("x.one") > F.col("y.one")).select(F.col("x.rid").alias("later"), F.col("y.rid").alias("earlier"))
    pairs = written(pairs.unionByName(often).distinct())
    a = own.select(F.col("rid").alias("earlier"), F.col("hashes").alias("ha"))
    b = own.select(F.col("rid").alias("later"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def lost(pairs):
        return written(pairs.join(a, "earlier").join(b, "later").select("later", "ha", "hb", "cb").mapInArrow(_aligned(min_words), "rid long, gone binary"))

    def left(asked):
        asked = asked.groupBy("rid").agg(F.collect_list("run").alias("asked"))
        found = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.collect_set("gone").alias("gone"))
        return written(asked.join(own, "rid").join(found, "rid", "left").select("rid", "hashes", "counts", "asked", "gone").mapInArrow(_left(min_words), "rid long, run long"))

    met, parts = [pairs], [lost(pairs)]
    open_ = left(held.filter((F.col("n") > rare) & (F.col("rid") != F.col("first.rid"))))
    if not open_.isEmpty():
        placed = _placed(held.join(open_.select("run").distinct(), "run", "left_semi"))
        first = placed.groupBy("run").agg(F.min("place").alias("start"))
        before, after = 1, 5  # of a run's holders, the first has been met
        asked = written(open_.join(placed, ["rid", "run"]).join(first, "run").filter(F.col("place") > F.col("start") + before))
        while not asked.isEmpty():
            ahead = F.sequence(F.col("start") + before, F.least(F.col("start") + after, "place") - 1)
            wanted = asked.select(F.col("rid").alias("later"), F.explode(ahead).alias("place")).distinct()
            wanted = wanted.join(placed.select("place", F.col("rid").alias("earlier")), "place").select("later", "earlier").distinct()
            met.append(written(wanted.join(reduce(DataFrame.unionByName, met), ["later", "earlier"], "left_anti")))
            parts.append(lost(met[-1]))
            still = left(asked)
            before, after = after, 4 * after + 1
            rest = written(asked.join(still, ["rid", "run"]).filter(F.col("place") > F.col("start") + before))
            dropped(asked, still)
            asked = rest
        dropped(placed, asked)
    gone = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.collect_set("gone").alias("gone"))
    gone = gone.join(own.select("rid", "one", "counts"), "rid").select("one.doc_id", "one.th", "gone", "counts").mapInArrow(_joined, "doc_id long, th long, gone array<int>")
    out = written(gone.select("doc_id", "th", F.lit(False).alias("whole"), "gone").unionByName(copies))
    dropped(lines, reps, own, runs, held, open_, *met, *parts)
    return out


def _cut(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with __lines (of the text), __kept (those that stay) and __hit (whether any goes)."""
    gone = repeated_lines(docs, **options).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("whole").alias("__whole"), F.col("gone").alias("__gone"))
    # the list grows with the corpus: it is joined by sorted shuffles at every size, never broadcast
    both = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__th")), "left")
    both = both.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    left = F.filter("__lines", lambda x, i: ~F.array_contains("__gone", i))
    kept = F.when(F.col("__th").isNull(), F.col("__lines")).when(F.col("__whole"), F.array().cast("array<string>")).otherwise(left)
    return both.select(*docs.columns, "__lines", kept.alias("__kept"), F.col("__th").isNotNull().alias("__hit"))


def remaining_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, th, text (what is left; null stays null), n_lines, n_removed and
    removed_words."""
    cut = _cut(keyed(docs, "text"), **options)
    words = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.size(F.array_remove(F.split(x, "[\\x20\\x09-\\x0D]+"), "")))
    return cut.select(
        "doc_id", "th", F.when(F.col("__hit"), F.array_join("__kept", "\n")).otherwise(F.col("text")).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_removed"),
        F.when(F.col("__hit"), words(F.col("__lines")) - words(F.col("__kept"))).otherwise(F.lit(0)).cast("long").alias("removed_words"))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns with the repeated lines cut from text (and n_chars, if there, set
    anew). Documents left without a word by the cut go."""
    cut = _cut(docs, **options)
    cut = cut.withColumn("text", F.when(F.col("__hit"), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.filter(~F.col("__hit") | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(docs.columns)


def op2_line_dedup(spark, folder: str) -> DataFrame:
    left = remaining_lines(table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "removed_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
