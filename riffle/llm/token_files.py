"""Token ids in files of variable-length codes, ranked by frequency.

Layout of a folder: ``ranks`` holds the ids from the most to the least frequent (ties: the lesser id
first); ``blocks`` holds blocks of consecutive documents in ascending order of doc_id. A block stores the
rank of every id in one to four bytes, least significant first. How many is told by separate control
bytes, two bits a value, four values a byte. A reader looks control bytes up in a table of 256 x 4
lengths, whose running sum gives the place of every value, and gathers; there is no loop over values.
Blocks are rows of Parquet files, so that Spark's committer keeps them whole if a task is run twice.

The texts are encoded once, in the order they are read, so that no text is shuffled: each task writes plain ids
and counts them on the way (a table bounded by the vocabulary); the plain ids, two bytes each where the vocabulary
allows, are sorted into ranges of documents and coded block by block.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.llm.flat import slices, text_slices
from riffle.llm.shared import dropped, keyed, own_folder, table, written

END = 1
BLOCK = 1 << 18
#: Distinct words whose ids a worker keeps (some 200 bytes each); beyond, it starts anew.
KEPT_WORDS = 1_000_000
#: Signs that may be tokens of their own behind a letter or digit.
MARKS = ".,!?;:#$%&*"
#: Characters of new pieces that are encoded in one call.
JOINED = 1 << 16
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by a tokenizers file whose tokens never span a blank or a line feed. Texts are cut
    there, the pieces of a slice are told apart by Arrow, and every distinct piece is encoded once: a stem of
    letters or digits and the marks behind it apart, plain words by the tokenizer's model, the rest many in one
    call, where the place a token starts at tells the piece it belongs to.

    Whether the file is of this kind, folds case, keeps marks apart and takes plain words as they are is tried out;
    the texts of a file that joins pieces are encoded whole.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        full = self._full
        tries = ("word", "x1", "n\u00e9", "don't", "...", "a.b", "\u4e2d\u6587", "\U0001f600", "<|endoftext|>")
        self.cuts = all(full(a) + full(b) == full(f"{a} {b}") == full(f"{a}\n{b}") == full(f" {a}  {b}\n ") for a in tries for b in tries)
        self.folds = all(full(w.upper()) == full(w) for w in ("word", "\u00e9t\u00e9", "q", "stra", "zzxqvw"))
        runs = [*MARKS, *(a + b for a in MARKS for b in MARKS), MARKS]
        self.marks = MARKS if all(full(w + m) == full(w) + full(m) for w in ("word", "x1", "n\u00e9") for m in runs) else ""
        self.plain = all(full(w) == self._word(w) for w in ("word", "q", "zzxqvw", "internationalisation"))
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _full(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        starts = np.cumsum(sizes) - sizes
        ids, counts, s = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64), 0
        while s < len(pieces):
            e = max(s + 1, int(np.searchsorted(starts, starts[s] + JOINED)))
            got = self.tokenizer.encode(" ".join(pieces[s:e]), add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            at = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids[-1])) + starts[s]
            counts[s:e] = np.bincount(np.searchsorted(starts[s:e], at, "right") - 1, minlength=e - s)
            s = e
        return np.concatenate(ids), counts

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        stems, parts = [], {}
        for p in pieces:
            stem = p.rstrip(self.marks) if self.marks else p
            if len(stem) < len(p) and stem and stem[-1].isalnum() and stem[-1] < "\u0100":
                parts[p] = stem, p[len(stem):]
                stems += parts[p]
            else:
                stems.append(p)
        atoms = [x for x in dict.fromkeys(stems) if x not in self.number]
        words = [x for x in atoms if x.isascii() and x.isalpha()] if self.plain and self.folds else []
        own = set(words)
        rest = [x for x in atoms if x not in own]
        found = [self._word(w.lower()) for w in words]
        self._keep(words, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self._keep(rest, *self._joined(rest))
        if parts := {p: x for p, x in parts.items() if p not in self.number}:
            both = np.fromiter((self.number[x] for pair in parts.values() for x in pair), np.int64, 2 * len(parts))
            ids, counts = self._gathered(both)
            self._keep(list(parts), ids, counts.reshape(-1, 2).sum(axis=1))

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces end to end, and how many each has."""
        first = self.starts[at]
        counts = self.starts[at + 1] - first
        upto = np.cumsum(counts)
        return self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - counts), counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if not self.cuts:
            whole = [self._full(t) for t in texts]
            return np.fromiter(chain.from_iterable(whole), np.uint32), np.fromiter(map(len, whole), np.int64, len(whole))
        column = pa.array(texts, pa.large_string())
        if self.folds:  # done here, fewer pieces differ. A special token keeps its case.
            column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        kinds = lists.flatten().dictionary_encode()
        if len(self.number) > KEPT_WORDS:
            self._clear()
        names = kinds.dictionary.to_pylist()
        found = np.fromiter((self.number.get(x, -1) for x in names), np.int64, len(names))
        if len(new := np.flatnonzero(found < 0)):
            new_names = [names[i] for i in new.tolist()]
            self._learn(new_names)
            found[new] = np.fromiter(map(self.number.__getitem__, new_names), np.int64, len(new))
        at = found[kinds.indices.to_numpy()]
        ids, counts = self._gathered(at)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(counts + 1) - 1] = False
    out[own] = ids
    return out, counts + 1


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    whole = np.ascontiguousarray(ranks, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return control.sum(axis=1, dtype=np.uint8).tobytes(), whole[np.arange(4) < size[:, None]].tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(size, dtype=np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = end - size
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _encoded(path: str, end: int | None, size: int):
    """Plain ids of each text, and, as a last row of each task, how often it has met each id."""
    def run(batches):
        coder = Encoder.of(path)
        width, total = np.dtype(_width(size)), np.zeros(size, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, counts = coder.encode(texts)
                if end is not None:
                    ids, counts = with_end(ids, counts, end)
                total += np.bincount(ids, minlength=size)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * width.itemsize
                own = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(width))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(counts), own, pa.nulls(len(texts), pa.binary())], names=PLAIN_NAMES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, None, np.stack([some, total[some]]).tobytes()), kinds)], names=PLAIN_NAMES)

    return run


def _counted(batches):
    for batch in batches:
        for raw in batch.column("times"):
            ids, n = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])


def _coded(rank: np.ndarray, width: str, block: int):
    def run(batches):
        number = before = 0
        for batch in batches:
            for part in slices(batch, "ids", block * np.dtype(width).itemsize):
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), width)
                control, data = packed(rank[ids])
                yield pa.RecordBatch.from_arrays([
                    part.column("part").slice(0, 1), pa.array([number]), pa.array([before]), pa.array([len(ids)]),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("n").to_pylist()], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=[*HEAD, "control", "data"])
                number, before = number + 1, before + len(ids)

    return run


PLAIN_NAMES = ["doc_id", "th", "n", "ids", "times"]
HEAD = ["part", "block", "before", "n", "doc_ids", "counts"]
BLOCKS = "part int, block long, before long, n long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int | None = END, block: int = BLOCK) -> None:
    """Write the ids of all texts to ``folder``. Null texts are empty; null ids come first; rows equal in
    id are ordered by the hash of their text; an empty table gives empty files. ``path``: a tokenizers file; one
    whose tokens never span a blank or a line feed is read piece by piece, others text by text."""
    path = path or tokenizer_path()
    size = max(Encoder.of(path).size, (end or 0) + 1)
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plain = written(keyed(docs, "text").mapInArrow(_encoded(path, end, size), "doc_id long, th long, n long, ids binary, times binary"))
    freq = plain.select("times").filter("times is not null").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    times = np.zeros(size, np.int64)
    for r in freq.collect():  # at most one row for each id of the vocabulary
        times[r.id] = r.n
    by_rank = np.lexsort((np.arange(size), -times))
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    order = [F.asc_nulls_first("doc_id"), F.asc("th")]
    rows = plain.filter("n is not null").select("doc_id", "th", "n", "ids").repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids").mapInArrow(_coded(rank, _width(size), block), BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    dropped(plain)


def _opened(by_rank: np.ndarray):
    def run(batches):
        for batch in batches:
            for start, docs, counts, n, control, data in zip(*(batch.column(c) for c in ("start", "doc_ids", "counts", "n", "control", "data"))):
                ids = by_rank[unpacked(control.as_py(), data.as_py(), n.as_py())]
                counts = np.array(counts.as_py(), np.int64)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                own = [raw[4 * (e - c):4 * e] for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    docs.values, pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) per document."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # the vocabulary
    by_rank = np.array([r.id for r in ranks], np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("own"))  # a row for each range
    parts = parts.select(F.col("part").alias("p"), (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("offset"))
    placed = blocks.join(parts, F.col("part") == F.col("p")).withColumn("start", F.col("offset") + F.col("before"))
    return placed.mapInArrow(_opened(by_rank), "doc_id long, start long, n_tokens long, ids binary")


def _checksum(batches):
    for batch in batches:
        sums = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_files(spark, folder: str) -> DataFrame:
    to = own_folder(spark)
    write_ids(table(spark, folder, "documents"), to)
    return read_ids(spark, to).mapInArrow(_checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
