"""Exact removal of repeated substrings over all documents, by sorted suffix tuples.

Every window of ``length`` bytes is a suffix cut to ``length``. The operator decides for each window
whether the same bytes start anywhere else, without ever writing one tuple per byte:

1. *Sample.* In each window the 64-byte gram with the least hash is its anchor (the last on ties). It
   depends on the window's bytes alone, so equal windows have their anchors at the same offset. The
   windows of one anchor are a run of offsets; on average one anchor serves 168 windows.
2. *Tuples.* One suffix tuple per anchor: (gram, run of offsets, proved prefix, possible prefix). Proved:
   a 128-bit hash of all bytes that the run's windows cover; equal ones share all their windows.
   Possible: a hash of the bytes common to all those windows; one that stands alone shares none.
3. *Naming.* Spark's spilling sort aggregation groups the tuples by (possible prefix, run, proved
   prefix). It is the disk-backed queue here: it holds any amount, and spreads over all executors.
4. *Recursive induction.* Tuples that are neither shared nor alone give way to tuples of shorter runs
   (at most 64, then 8, then 1 window), whose common prefixes lie closer together; a class of equal
   tuples goes on as one representative, so copies and frequent passages never meet pair by pair.
   At runs of one window both hashes are of the window itself and all is decided.

Offsets are cut at multiples of the run length, so that tuples from different documents are
comparable although their anchors' runs end at different places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.flat import prefix_hash, stretch_hash
from riffle.llm.shared import bytes_of, dropped, keyed, table, written

GRAM = 64
RUNS = (64, 8, 1)
PIECE = 1 << 20
NODE = "doc_id long, th long, a long, lo int, hi int, c long, u1 long, u2 long, settled boolean"
KINDS = {"doc_id": pa.int64(), "th": pa.int64(), "a": pa.int64(), "lo": pa.int32(), "hi": pa.int32(),
         "c": pa.int64(), "u1": pa.int64(), "u2": pa.int64(), "settled": pa.bool_()}


def _anchors(data: np.ndarray, length: int, gram: int):
    """(anchor, least offset, greatest offset, gram hash) of a text's windows, all as arrays."""
    found = []
    step = PIECE - length + 1
    reach = length - gram + 1
    for base in range(0, max(1, len(data) - length + 1), step):
        piece = data[base:base + PIECE]
        windows = len(piece) - length + 1
        if windows <= 0:
            break
        prefix = prefix_hash(piece)
        starts = np.arange(len(piece) - gram + 1)
        hashes = stretch_hash(prefix, starts, starts + gram)
        low = np.uint64(PIECE - 1)
        keys = (hashes & ~low) | (low - starts.astype(np.uint64))
        blocks = -(-len(keys) // reach)
        grid = np.full(blocks * reach, np.uint64(2**64 - 1))
        grid[:len(keys)] = keys
        grid = grid.reshape(blocks, reach)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[reach - 1:reach - 1 + windows])
        anchor = (low - (least & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        at = anchor[first]
        found.append((base + at, at - last, at - first, hashes[at].view(np.int64)))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(x) for x in zip(*found)]


def _proved(view, pieces) -> np.ndarray:
    """128-bit hashes of stretches of bytes as an n x 2 array."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(view[s:e]) for s, e in pieces), np.int64).reshape(-1, 2)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, KINDS[k]) for k, v in columns.items()], names=list(columns))


def _first_tuples(length: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            held, size = [], 0
            for doc, th, text in zip(ids, hashes, batch.column("data")):
                view = memoryview(text.as_buffer())
                a, lo, hi, c = _anchors(np.frombuffer(view, np.uint8), length, gram)
                if not len(a):
                    continue
                u = _proved(view, zip((a - hi).tolist(), (a - lo + length).tolist()))
                held.append(([doc] * len(a), [th] * len(a), a, lo, hi, c, u))
                size += len(a)
                if size >= 20_000:
                    yield _nodes(held)
                    held, size = [], 0
            if held:
                yield _nodes(held)

    return run


def _nodes(held) -> pa.RecordBatch:
    ids, hashes, *arrays = zip(*held)
    a, lo, hi, c, u = (np.concatenate(x) for x in arrays)
    return _batch({"doc_id": sum(ids, []), "th": sum(hashes, []), "a": a, "lo": lo, "hi": hi, "c": c,
                   "u1": u[:, 0], "u2": u[:, 1], "settled": np.zeros(len(a), bool)})


def _cells(lo: int, hi: int, run: int):
    """Runs of at most ``run`` offsets, cut at its multiples: (least, greatest, cell)."""
    for cell in range(lo // run, hi // run + 1):
        yield max(lo, cell * run), min(hi, cell * run + run - 1), cell


def _induced(run: int, length: int, keep_bytes: bool):
    """Tuples of shorter runs from tuples with the bytes around them. ``data`` begins at byte ``base``;
    ``nodes`` are the tuples that lie in it."""
    whole, common = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest

    def go(batches):
        for batch in batches:
            out = {k: [] for k in [*KINDS, *(["data"] if keep_bytes else [])]}
            for doc, th, base, text, nodes in zip(*(batch.column(k) for k in ("doc_id", "th", "base", "data", "nodes"))):
                view = memoryview(text.as_buffer())
                doc, th, base = doc.as_py(), th.as_py(), base.as_py()
                for node in nodes.as_py():
                    a = node["a"] - base
                    for lo, hi, cell in _cells(node["lo"], node["hi"], run):
                        core = view[a - cell * run:a - cell * run - run + 1 + length]
                        u = whole(view[a - hi:a - lo + length])
                        row = (doc, th, node["a"], lo, hi, _signed(common(core, seed=cell)),
                               int.from_bytes(u[:8], "little", signed=True),
                               int.from_bytes(u[8:], "little", signed=True), node["settled"])
                        for k, v in zip(KINDS, row):
                            out[k].append(v)
                        if keep_bytes:
                            out["data"].append(bytes(view[a - hi:a - lo + length]))
                if len(out["a"]) >= 20_000:
                    yield _with_bytes(out)
                    out = {k: [] for k in out}
            if out["a"]:
                yield _with_bytes(out)

    return go


def _with_bytes(out: dict) -> pa.RecordBatch:
    kinds = KINDS | {"data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _named(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows found shared; the tuples to go on with: one representative per class, from groups
    with several classes of which one at least is undecided; and the table of classes behind both."""
    classes = written(
        nodes.groupBy("c", "lo", "hi", "u1", "u2").agg(
            F.count(F.lit(1)).alias("n"), F.max("settled").alias("was"),
            F.min(F.struct("doc_id", "th", "a")).alias("one")))
    shared = nodes.filter(~F.col("settled")).join(
        classes.filter("n > 1").select("c", "lo", "hi", "u1", "u2"), ["c", "lo", "hi", "u1", "u2"], "left_semi")
    groups = classes.groupBy("c").agg(
        F.count(F.lit(1)).alias("k"), F.sum(((F.col("n") == 1) & ~F.col("was")).cast("int")).alias("undecided"))
    onward = (classes.join(groups.filter("k > 1 and undecided > 0").select("c"), "c", "left_semi")
              .select("one.doc_id", "one.th", "one.a", "lo", "hi", (F.col("was") | (F.col("n") > 1)).alias("settled")))
    shared = shared.select("doc_id", "th", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))
    return written(shared), onward, classes


def repeated_windows(docs: DataFrame, length: int = 400) -> DataFrame:
    """Runs of window starts whose ``length`` bytes also start elsewhere: doc_id, th, first, last.

    ``docs`` needs doc_id and text; th is the text's hash (``shared.text_hash``). Runs of one document
    may overlap or repeat. Null texts are empty and have no window; rows that repeat a whole row count
    as further documents; null ids are one id; an empty table gives no rows.
    """
    gram = min(GRAM, length)
    texts = keyed(docs, bytes_of().alias("data"))
    nodes = written(texts.filter(F.length("data") >= length).mapInArrow(_first_tuples(length, gram), NODE))
    found, onward, classes = _named(nodes)
    results, spent = [found], [nodes, classes]

    def of_document(tuples: DataFrame) -> DataFrame:
        """The tuples beside the whole text of their document."""
        per = tuples.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "lo", "hi", "settled")).alias("nodes"))
        left = texts.alias("t")
        return left.join(per.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.th") == F.col("p.th"))).select(
            "t.doc_id", "t.th", F.lit(0).cast("long").alias("base"), "t.data", "p.nodes")

    runs = [r for r in RUNS if r == 1 or 2 * r <= length]
    nodes = written(of_document(onward).mapInArrow(_induced(runs[0], length, False), NODE))
    found, onward, classes = _named(nodes)
    results.append(found)
    spent += [nodes, classes]
    around = written(of_document(onward).mapInArrow(_induced(runs[0], length, True), NODE + ", data binary"))
    spent.append(around)
    for run in runs[1:]:
        own = F.array(F.struct("a", "lo", "hi", "settled")).alias("nodes")
        base = (F.col("a") - F.col("hi")).alias("base")
        nodes = written(around.select("doc_id", "th", base, "data", own).mapInArrow(_induced(run, length, True), NODE + ", data binary"))
        found, onward, classes = _named(nodes.drop("data"))
        results.append(found)
        spent += [nodes, classes]
        if run > 1:
            keys = ["doc_id", "th", "a", "lo", "hi"]
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
            around = written(nodes.alias("n").join(onward.alias("o"), same).select(
                *[F.col(f"n.{k}") for k in keys], F.col("o.settled"), F.col("n.data")).dropDuplicates(keys))
            spent.append(around)
    dropped(*spent)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _removed(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(k) for k in ("doc_id", "data", "spans"))):
                data = text.as_py()
                n = len(data)
                if spans.is_valid and len(spans):
                    change = np.zeros(n + 1, np.int64)
                    first = spans.values.field("first").to_numpy()
                    last = spans.values.field("last").to_numpy()
                    np.add.at(change, first, 1)
                    np.add.at(change, last + length, -1)
                    gone = np.cumsum(change[:n]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    rows.append((doc.as_py(), n, n - len(kept), runs, kept))
                else:
                    rows.append((doc.as_py(), n, 0, 0, data))
            ids, sizes, removed, runs, kept = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Every document without the bytes that a repeated window of ``length`` bytes covers.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes), one row per input row.
    Null texts are empty texts; whole repeated rows lose everything that is long enough; other columns
    are left behind.
    """
    runs = repeated_windows(docs, length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    texts = keyed(docs, bytes_of().alias("data")).alias("t")
    r = runs.alias("r")
    return texts.join(r, F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.th") == F.col("r.th")), "left").select(
        "t.doc_id", "t.data", "r.spans").mapInArrow(
        _removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept")


#: Every window of every text, by its digest.
SQL="""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rn, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (
  SELECT rn, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
r AS (SELECT rn, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
b AS (SELECT rn, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rn ORDER BY p) + 400 THEN 0 ELSE 1 END AS b FROM r),
g AS (SELECT rn, p, sum(b) OVER (PARTITION BY rn ORDER BY p) AS g FROM b),
s AS (SELECT rn, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY rn, g),
n AS (SELECT rn, sum(z - a) AS gone, count(*) AS spans FROM s GROUP BY rn),
e AS (SELECT rn, 0 AS x, 's' AS kind FROM d UNION ALL SELECT rn, z, 's' FROM s UNION ALL SELECT rn, a, 'e' FROM s UNION ALL SELECT rn, len(h) // 2, 'e' FROM d),
o AS (SELECT rn, kind, x, row_number() OVER (PARTITION BY rn, kind ORDER BY x) AS i FROM e),
k AS (SELECT x.rn, string_agg(substr(h, 2 * x.x + 1, 2 * (y.x - x.x)), '' ORDER BY x.i) AS kept
  FROM o x JOIN o y ON x.rn = y.rn AND x.i = y.i AND x.kind = 's' AND y.kind = 'e' JOIN d ON d.rn = x.rn GROUP BY x.rn)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (rn) LEFT JOIN n USING (rn)"""
