"""Near-duplicate classes by DartMinHash signatures, banded joins and exact checks.

*Signatures.* Every document is a weighted set of shingles of five words (lower case, split at ASCII
white space; a shorter text is one shingle). An element of weight w owns the region [0, w) x [0, inf)
of a plane of weight and rank. Darts fall on the plane with density one, at places that depend on the
element alone. Those of rank under t / (total weight), with t = k ln k + 2k, are kept: about t darts,
whatever the size of the text. Each dart has a hashed coordinate; the earliest dart of a coordinate is
the signature there. Where a coordinate stays empty, the rank limit doubles. Two signatures agree at a
coordinate with probability equal to the weighted Jaccard similarity.

*Bands.* 26 bands of 5 coordinates: a pair of similarity 0.8 shares no band once in 30,000 times.

*Links.* Texts of equal words are one class from the start. In a bucket every member is held against
one head, the member whose buckets are fullest, not against all others; similarity is computed exactly.
Members that end up outside the head's component get a head of their own, for some rounds; what is
still apart then is compared with every member of its bucket outside its component, unless the two
cannot be near: both need 4/9 of their sizes together in common, and shingles that stand in up to ``FEW``
members of all these buckets are common to the pairs that an index of these shingles gives, and to no
others. So no pair that shares a bucket is left out unless it is in one class already or shown not to be
near, and a huge group costs a line per member.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.components import components
from riffle.llm.flat import chunks, mix, spread_ranges, text_slices, words_of
from riffle.llm.shared import dropped, keyed, table, written

WORDS = 5
BANDS, ROWS = 26, 5
SIMILARITY = 0.8
HEAD_ROUNDS = 2
#: Sets that an element may be in to count as rare in the last comparison: changes its cost, not its result.
FEW = 8
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Shingle hashes of each text in order, repeats included. Texts are lower case already."""
    out: list[np.ndarray] = []
    for s, e in chunks(texts):
        hashes, bounds = words_of(texts[s:e])
        n = len(hashes) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(words if n > 0 else 0):
            rolled += hashes[j:j + n] * PLACES[j % len(PLACES)] * np.uint64(2 * (j // len(PLACES)) + 1)
        rolled = mix(rolled)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= words:
                out.append(rolled[lo:hi - words + 1])
            elif hi > lo:
                mixed = mix(np.array([hi - lo], np.uint64) + (hashes[lo:hi] * PLACES[np.arange(hi - lo) % len(PLACES)]).sum(dtype=np.uint64))
                out.append(mixed)
            else:
                out.append(hashes[:0])
    return out


def weighted(found: np.ndarray, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights: 1 (set), times (count) or 1 + ln times (log)."""
    if weight == "set":
        kinds = np.unique(found)
        return kinds, np.ones(len(kinds))
    kinds, times = np.unique(found, return_counts=True)
    return kinds, times.astype(float) if weight == "count" else 1 + np.log(times)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of k coordinates for each weighted set; sets must not be empty."""
    n = len(sets)
    out_id = np.zeros(n * k, np.uint64)
    out_rank = np.full(n * k, np.inf)
    if not n:
        return out_id.reshape(0, k)
    sizes = np.array([len(x) for x, _ in sets])
    element, weight = np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets])
    limit = (k * math.log(k) + 2 * k) / np.add.reduceat(weight, np.cumsum(sizes) - sizes)
    of = np.repeat(np.arange(n), sizes)
    # one strip of the plane for each whole or begun unit of weight
    strip_of, strip = spread_ranges(np.ceil(weight).astype(np.int64))
    owner, room = of[strip_of], weight[strip_of] - strip
    seed = mix(element[strip_of] + strip.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    turn = np.ones(len(seed), np.uint64)
    state = mix(seed + turn)
    rank = _gap(state)
    open_ = np.arange(len(seed))
    while True:
        active = open_
        while len(active := active[rank[active] < limit[owner[active]]]):
            dart = mix(state[active] ^ np.uint64(0xA0761D6478BD642F))
            hit = (mix(dart) >> np.uint64(11)) * 2.0**-53 < room[active]
            slot = owner[active] * k + (dart % np.uint64(k)).astype(np.int64)
            slot, dart, at = slot[hit], dart[hit], rank[active][hit]
            before = out_rank[slot]
            np.minimum.at(out_rank, slot, at)
            best = (at < before) & (at == out_rank[slot])
            out_id[slot[best]] = dart[best]
            turn[active] += np.uint64(1)
            state[active] = mix(seed[active] + turn[active])
            rank[active] += _gap(state[active])
        short = np.isinf(out_rank).reshape(n, k).any(axis=1)
        if not short.any():
            return out_id.reshape(n, k)
        limit[short] *= 2
        open_ = open_[short[owner[open_]]]


def _gap(state: np.ndarray) -> np.ndarray:
    return -np.log(((state >> np.uint64(11)) + 0.5) * 2.0**-53)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signatures.reshape(len(signatures), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2])
    for r in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return acc.view(np.int64)


def _signed(words: int, weight: str, bands: int, rows: int):
    digest = xxhash.xxh3_128_digest

    def run(batches):
        for batch in batches:
            for rows_in, texts in text_slices(batch):
                part = [t.lower().encode() for t in texts]
                sets = [weighted(x, weight) for x in shingles(part, words)]
                full = [i for i, (x, _) in enumerate(sets) if len(x)]
                hashes = band_hashes(dart_signatures([sets[i] for i in full], bands * rows), bands, rows)
                rows_of: list = [None] * len(part)
                for i, h in zip(full, hashes):
                    rows_of[i] = h
                keys = np.frombuffer(b"".join(digest(b" ".join(t.split())) for t in part), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    rows_in.column("doc_id"), rows_in.column("th"), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.array(rows_of, pa.list_(pa.int64()))], names=["doc_id", "th", "w1", "w2", "bands"])

    return run


def _sets(words: int, weight: str):
    def run(batches):
        for batch in batches:
            for rows_in, texts in text_slices(batch):
                sets = [weighted(x, weight) for x in shingles([t.lower().encode() for t in texts], words)]
                yield pa.RecordBatch.from_arrays([
                    rows_in.column("rid"), pa.array([x.tobytes() for x, _ in sets], pa.binary()),
                    pa.array([None if weight == "set" else w.tobytes() for _, w in sets], pa.binary())], names=["rid", "elements", "weights"])

    return run


def similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray | None = None, wb: np.ndarray | None = None) -> float:
    """Weighted Jaccard similarity of two sets with ascending distinct elements."""
    if wa is None:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared / max(1, len(a) + len(b) - shared)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wa[i], wb[j]).sum())
    return shared / max(1e-300, float(wa.sum() + wb.sum()) - shared)


def _elements(batches):
    """rid, element, weight and the set's total weight, a row for each element."""
    for batch in batches:
        for rid, elements, weights in zip(batch.column("rid").to_pylist(), batch.column("elements"), batch.column("weights")):
            e = np.frombuffer(elements.as_buffer(), np.int64)
            w = np.frombuffer(weights.as_buffer()) if weights.is_valid else np.ones(len(e))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), rid)), pa.array(e), pa.array(w), pa.array(np.full(len(e), w.sum()))],
                                             names=["rid", "e", "w", "total"])


def _frequent(sets: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(rid, total, common) with each set's weight and how much of it lies in elements of more than
    ``few`` sets; and (rid, e, w) of the elements of two to ``few`` sets."""
    long = written(sets.mapInArrow(_elements, "rid long, e long, w double, total double"))
    n = long.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= few)
    rare = written(long.join(n, "e"))
    lost = rare.groupBy("rid").agg(F.sum("w").alias("lost"))
    totals = long.groupBy("rid").agg(F.max("total").alias("total"))
    found = totals.join(lost, "rid", "left").select("rid", "total", (F.col("total") - F.coalesce("lost", F.lit(0.0))).alias("common"))
    return written(found), rare.filter("n > 1").select("rid", "e", "w")


def _checked(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (ea, eb, wa, wb) in enumerate(zip(*(batch.column(c) for c in ("ea", "eb", "wa", "wb")))):
                a, b = np.frombuffer(ea.as_buffer(), np.uint64), np.frombuffer(eb.as_buffer(), np.uint64)
                if min(len(a), len(b)) < least * max(len(a), len(b)) and not wa.is_valid:
                    continue
                w = (np.frombuffer(wa.as_buffer()), np.frombuffer(wb.as_buffer())) if wa.is_valid else (None, None)
                if similarity(a, b, *w) >= least - 1e-12:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, weight: str = "set",
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, th (the text's hash), cluster_id (least doc_id of the class),
    cluster_size (rows), n_links (links found between different texts; 0 for a copy that does not
    stand for its class of equal words) and kept (true for one row of every class).

    Null texts and texts without a word are alike to nothing, themselves included. Rows that repeat
    each other are copies like any other: one of them is kept. Null ids come before all others. An
    empty table gives no rows; only doc_id and text are read.
    """
    members = written(keyed(docs, "text").mapInArrow(
        _signed(words, weight, bands, rows), "doc_id long, th long, w1 long, w2 long, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    first = F.struct("doc_id", "th", "row")
    reps = written(members.filter("bands is not null").groupBy("w1", "w2").agg(F.min(first).alias("one"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("rid", F.monotonically_increasing_id()).select("rid", "w1", "w2", "one", "copies"))
    buckets = written(reps.select("rid", F.col("one.row").alias("row")).join(members.select("row", "bands"), "row")
                      .select("rid", F.posexplode("bands").alias("band", "h")))
    sizes = buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(buckets.join(sizes, ["band", "h"]))
    degree = shared.groupBy("rid").agg(F.sum("n").alias("degree"))
    shared = written(shared.drop("n").join(degree, "rid"))
    texts = keyed(docs, "text").alias("t")
    wanted = reps.join(degree, "rid", "left_semi").select("rid", "one.doc_id", "one.th").alias("w")
    sets = written(texts.join(wanted, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
                   .select("w.rid", "t.text").dropDuplicates(["rid"])
                   .mapInArrow(_sets(words, weight), "rid long, elements binary, weights binary"))

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("rid").alias(c), F.col("elements").alias(f"e{c}"), F.col("weights").alias(f"w{c}"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb", "wa", "wb")
                       .mapInArrow(_checked(least), "a long, b long"))

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # heads: the fullest member of each bucket, then of what each round leaves apart from its head
    left = shared.withColumn("root", F.lit(None).cast("long"))
    done = links = None
    for _ in range(HEAD_ROUNDS):
        heads = left.groupBy("band", "h").agg(F.max(F.struct("degree", F.col("rid").alias("head"))).alias("m")).select("band", "h", "m.head")
        pairs = left.join(heads, ["band", "h"]).filter("rid <> head").select(*ordered("rid", "head")).distinct()
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        found = check(pairs)
        links, done = (found, pairs) if done is None else (links.union(found), done.union(pairs))
        roots = components(links)
        rooted = written(shared.join(roots.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
        # a bucket's largest component is settled; the rest goes on
        per = rooted.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("n"))
        main = per.groupBy("band", "h").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        left = written(rooted.join(main.select("band", "h", F.col("m.root").alias("main")), ["band", "h"]).filter("root <> main").drop("main"))
    mixed = rooted.join(left.select("band", "h").distinct(), ["band", "h"], "left_semi")
    common, rare = _frequent(sets.join(mixed.select("rid").distinct(), "rid", "left_semi"), FEW)
    mine = lambda df: df.join(common, "rid")
    need = (least / (1 + least) - 1e-9) * (F.col("tx") + F.col("total"))
    as_x = {"rid": "x", "root": "rx", "total": "tx", "common": "cx", "w": "wx"}
    y = mine(mixed.select("band", "h", "rid", "root"))
    x = mine(left.select("band", "h", "rid", "root")).withColumnsRenamed(as_x)
    x, y = (d.filter(F.col(c) >= (least - 1e-9) * F.col(t)) for d, c, t in ((x, "cx", "tx"), (y, "common", "total")))
    across = x.join(y, (x.band == y.band) & (x.h == y.h) & (F.col("rx") != F.col("root")) & (F.least("cx", "common") >= need)).select("x", "rid")
    roots_of = mixed.select("rid", "root").distinct()
    y = mine(rare.join(roots_of, "rid"))
    x = y.join(left.select("rid").distinct(), "rid", "left_semi").withColumnsRenamed(as_x).withColumnRenamed("e", "ex")
    by_rare = (x.join(y, (F.col("ex") == F.col("e")) & (F.col("rx") != F.col("root")))
               .groupBy("x", "rid").agg(F.sum(F.least("wx", "w")).alias("both"), F.first("tx").alias("tx"), F.first("cx").alias("cx"), F.first("total").alias("total"), F.first("common").alias("common"))
               .filter(F.least("cx", "common") + F.col("both") >= need).select("x", "rid"))
    across = across.union(by_rare).select(*ordered("x", "rid")).distinct()
    across = written(across.join(done, ["a", "b"], "left_anti"))
    links = links.union(check(across))
    roots = components(links)
    many = links.select(F.col("a").alias("rid")).union(links.select("b")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    classes = written(reps.join(roots.withColumnRenamed("id", "rid"), "rid", "left").join(many, "rid", "left")
                      .select("w1", "w2", F.col("one.row").alias("stands"), "one", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    whole = classes.groupBy("root").agg(F.min("one").alias("top"), F.sum("copies").alias("cluster_size"))
    named = classes.join(whole, "root").select("w1", "w2", "stands", "n_links", "top", "cluster_size")
    dropped(buckets, shared)
    return members.filter("bands is null").select(
        "doc_id", "th", F.col("doc_id").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"),
        F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")
    ).unionByName(members.filter("bands is not null").join(named, ["w1", "w2"]).select(
        "doc_id", "th", F.col("top.doc_id").alias("cluster_id"), "cluster_size",
        F.when(F.col("row") == F.col("stands"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        (F.col("row") == F.col("top.row")).alias("kept")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns, one row of every class of near duplicates (see ``near_duplicates``)."""
    keep = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    out = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())).join(keep.distinct(), same, "left_semi")
    # rows alike in id and text: those with words are one class and one stays; the others all stay
    worded = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return out.filter(worded).dropDuplicates(["doc_id", "__hash"]).unionByName(out.filter(~worded)).drop("__hash")


def op6_near_duplicates(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).drop("th")
