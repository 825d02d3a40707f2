"""Periodic runs of words: sparse diagonal dynamic programming over lags.

A cell (word i, lag q) is live where word i equals word i - q; its value is one more than the cell before it
on the same diagonal, so it counts how many words in a row have matched at that lag. A diagonal that ends at
word i with m matches is a stretch of m + q words with period q, and no neighbour extends it. It is a run if
m >= q and m + q >= the least length.

Only the cells that can end a run are visited. Words are named by themselves, and stretches of 2, 4, 8 ... words
by the pair of names of their halves, as long as a name occurs twice in the text: a match of m words at lag q in
[L, 2L) holds a repeated stretch of L words, so the lags of a word are the distances to the earlier occurrences
of the stretch that ends there, nearer than 2L. A cell is an end where the words behind the two occurrences
differ. Occurrences of one stretch nearer than L belong to one periodic piece, all but the last of which go on
alike, so a level has about as many ends as words, even in a text of one word repeated a million times (where the
whole table has half a million million cells). The value of an end cell is read off the names, from the longest
stretches down; there is no hashing, so equal names are equal words.

Of the diagonals with the same first and last word the least lag is the smallest period: the others are its
multiples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riffle.llm.flat import spread_ranges, text_slices
from riffle.llm.shared import table

LEAST = 12
#: Levels whose stretches seed the lags: lags under 8 by stretches of 4 words, [8, 16) by 8, [16, 32) by 16 ...
FIRST_LEVEL = 2
RUNS = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Names(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number, or -1 where the key occurs once; and the places of the others."""
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    often = times[name] > 1
    return np.where(often, name, -1), np.flatnonzero(often)


def _levels(words: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Level k: the name of the stretch of 2**k words that ends at each word, -1 where it occurs once in
    its text. Names of different texts differ."""
    names, alive = _named(owner * (int(words.max(initial=0)) + 1) + words)
    out, size = [names], 1
    while len(alive):
        ends = alive[(alive >= size)]
        ends = ends[owner[ends - size] == owner[ends]]
        left = out[-1][ends - size]
        ends, left = ends[left >= 0], left[left >= 0]
        name, often = _named(left * (int(out[-1].max()) + 1) + out[-1][ends])
        level = np.full(len(words), -1, np.int64)
        level[ends] = name
        out.append(level)
        alive, size = ends[often], size * 2
    return out


def _end_cells(names: np.ndarray, low: int, high: int, behind: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) of the end cells with low <= lag < high among equal names of one level."""
    at = np.flatnonzero(names >= 0)
    order = np.argsort(names[at], kind="stable")
    at = at[order]
    name, nxt = names[at], behind[at]
    group = np.cumsum(np.concatenate([[True], name[1:] != name[:-1]])) - 1 if len(at) else name
    # a place within (group, word) order, so that one search finds the window of every word
    span = len(names) + 2 * high
    place = group * span + at
    first = np.searchsorted(place, np.maximum(group * span, place - high + 1))
    last = np.searchsorted(place, place - low, side="right")
    # occurrences side by side that go on alike are one block: skipped whole where they go on like the word itself
    block = np.cumsum(np.concatenate([[True], (nxt[1:] != nxt[:-1]) | (group[1:] != group[:-1])])) - 1 if len(at) else name
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else at
    bounds = np.append(starts, len(at))
    some = np.flatnonzero(last > first)
    head, tail = block[first[some]], block[last[some] - 1]
    who, nth = spread_ranges(tail - head + 1)
    cell, piece = some[who], head[who] + nth
    differ = nxt[starts[piece]] != nxt[cell]
    cell, piece = cell[differ], piece[differ]
    a, b = np.maximum(bounds[piece], first[cell]), np.minimum(bounds[piece + 1], last[cell])
    who, nth = spread_ranges(b - a)
    end, earlier = at[cell[who]], at[a[who] + nth]
    return end, end - earlier


def runs_of(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, end inclusive, by start, then period. ``words``: numbers of the words of
    several texts laid end to end; ``owner``: the text of each, ascending. No run crosses texts."""
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    levels = _levels(words, owner)
    # what stands behind a word: the next one, or something that occurs nowhere else behind the last
    last = np.append(owner[1:] != owner[:-1], True)
    behind = np.where(last, -1 - np.arange(n), np.append(words[1:], -1))
    found = []
    for k in range(FIRST_LEVEL, len(levels)):
        low = 1 if k == FIRST_LEVEL else 1 << k
        if (levels[k] >= 0).any():
            found.append(_end_cells(levels[k], low, 2 << k, behind, owner))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    end, lag = (np.concatenate(x) for x in zip(*found))
    match = np.zeros(len(end), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, open_ = levels[k], np.arange(len(end))
        while len(open_):
            here = end[open_] - match[open_]
            there = here - lag[open_]
            ok = there >= 0
            open_, here, there = open_[ok], here[ok], there[ok]
            same = (names[here] == names[there]) & (names[here] >= 0)
            open_ = open_[same]
            match[open_] += 1 << k
            if k < len(levels) - 1:
                break
    good = (match >= lag) & (match + lag >= least)
    end, lag, match = end[good], lag[good], match[good]
    start = end - match - lag + 1
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    if len(start):
        least_lag = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        start, end, lag = start[least_lag], end[least_lag], lag[least_lag]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def collapsed_words(n: int, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, or in the first period of every run that holds them."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + lag, 1)
    np.add.at(step, end + 1, -1)
    return np.cumsum(step[:n]) == 0


def _found(change: Callable[[object, int], np.ndarray | None] | None, least: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                names = _Names()
                split = [t.encode().split() for t in texts]  # bytes part at ASCII white space alone
                ids = part.column("doc_id").to_pylist()
                if change:
                    for i, (doc_id, words) in enumerate(zip(ids, split)):
                        if (at := change(doc_id, len(words))) is not None:
                            split[i] = list(map(words.__getitem__, at.tolist()))
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                upto = np.concatenate([[0], np.cumsum(sizes)])
                words = np.fromiter(map(names.__getitem__, chain.from_iterable(split)), np.int64, int(upto[-1]))
                start, end, lag = runs_of(words, np.repeat(np.arange(len(split)), sizes), least)
                keep = collapsed_words(len(words), start, end, lag)
                bounds = np.searchsorted(start, upto)
                rows = []
                for i, own in enumerate(split):
                    lo, hi, base = int(bounds[i]), int(bounds[i + 1]), int(upto[i])
                    s, e, q = start[lo:hi] - base, end[lo:hi] - base, lag[lo:hi]
                    best = (None, None, None)
                    if len(s):
                        b = int(np.lexsort((q, s, s - e))[0])
                        best = (int(s[b]), int(e[b] - s[b]) + 1, int(q[b]))
                        own = [w for w, k in zip(own, keep[base:base + len(own)].tolist()) if k]
                    rows.append((ids[i], int(sizes[i]), len(s), *best,
                                 [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), (e - s + 1).tolist(), q.tolist())],
                                 b" ".join(own).decode()))
                kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, change: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: n_words, n_runs, the longest run (ties: least start; null without runs), all ``runs``
    by start, then period, and ``collapsed``, the text without the repeats: a word goes if any run holds it behind
    the run's first period; kept words are joined by one blank.

    Words are runs without ASCII white space. A null or empty text has no words and no runs and collapses to an
    empty text. Rows are on their own, so repeated rows give repeated results, an empty table gives none, and a null
    doc_id stays. Of the input only ``doc_id`` and ``text`` are read, so other columns cannot clash. ``change``
    (doc_id, number of words) may name the words to look at in their place, by number.
    """
    return docs.select("doc_id", "text").mapInArrow(_found(change, least), RUNS)


def planted_repeats(doc_id, n: int) -> np.ndarray | None:
    """Every tenth document, by crc32 of its id, repeats one stretch of its words from some word on. A null id: never."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _digests(batches):
    for batch in batches:
        runs = [hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in x).encode()).hexdigest() for x in batch.column("runs").to_pylist()]
        kept = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("collapsed")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_runs", "start", "length", "period")), pa.array(runs, pa.string()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"])


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    """Runs of all documents, a tenth of which get planted repeats, as digests."""
    found = periodic_runs(table(spark, folder, "documents"), change=planted_repeats)
    out = found.mapInArrow(_digests, "doc_id long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string")
    return out.selectExpr("doc_id", "n_runs", "start", "length", "period", "(1000 * length) div period AS exponent_milli", "runs_sha256", "collapsed_sha256")
