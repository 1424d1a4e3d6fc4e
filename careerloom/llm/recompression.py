"""Substring dedup over words by recompression.

Rounds of recompression name token runs and token pairs. A name is a fingerprint of what it stands for, so equal words
get equal names in every document and every task, without a table of names. Which neighbours are put together depends
on the two alone, so inside equal passages the same symbol bounds appear, up to a few words from the ends. Every window
of k words picks one bound that lies deep enough inside it, by the least fingerprint of the words around; equal windows
pick the same. Spark counts the names of the picked places over all documents; windows whose place is named once occur
once. The others are candidates, compared by the fingerprint of all their words, and the earliest of equal windows is
found by an aggregate. What a document has to know, which of its places are unique and which windows are first, goes
back to it by its key; texts move once.

Null and blank texts have no words: nothing is removed and the kept text is empty. Rows equal in id and text count as one
document; rows that share an id but not the text are documents of their own, in the order of a digest of the text. Null
ids come before all others. Long runs of one word and texts without a bound inside a
window are handled by making their windows candidates outright. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import earliest, keyed_texts, mixed, rolling, slices, text_bytes, word_hashes

#: Words of a window, rounds of run and pair naming, and words on either side that a bound may depend on.
WINDOW, ROUNDS, RADIUS = 20, 2, 6
#: Stands for a null id while the operator works.
NO_ID = -(1 << 63)


@dataclass
class Symbols:
    """The symbols of one level: first word, name and row of each, and the words its left bound depends on."""

    start: np.ndarray
    name: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    level: int = 0

    @classmethod
    def of_words(cls, hashes: np.ndarray, rows: np.ndarray) -> Symbols:
        at = np.arange(len(hashes))
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        return cls(at, hashes, row, at, at)

    def joined(self, to_left: np.ndarray, name: np.ndarray, end: int) -> Symbols:
        """The next level: symbols marked in ``to_left`` become part of the one before; ``name`` is per symbol kept."""
        keep = np.flatnonzero(~to_left)
        before = np.append(self.low[:1], self.low[:-1])
        after = np.append(self.high[1:], end + (self.level > 0))[: len(keep) + int(to_left.sum())]
        low, high = np.minimum(self.low, before), np.maximum(self.high, after)
        # that words end where the text does is seen at once; that symbols do depends on the text being over
        edge = np.append(True, self.row[1:] != self.row[:-1])[: len(low)]
        low, high = np.where(edge, self.start - 1, low), np.where(edge, np.maximum(high, self.start + 1), high)
        return Symbols(self.start[keep], name, self.row[keep], low[keep], high[keep], self.level + 1)

    def runs(self, end: int) -> Symbols:
        """Maximal runs of one symbol get a name made of the symbol and the length."""
        same = np.append(False, (self.name[1:] == self.name[:-1]) & (self.row[1:] == self.row[:-1]))[: len(self.name)]
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, len(same))).astype(np.uint64)
        name = self.name[first]
        return self.joined(same, np.where(length > 1, mixed(name ^ mixed(length, 31), 37), name), end)

    def pairs(self, turn: int, end: int) -> Symbols:
        """Half of the alphabet, by a bit of the name, is left, half right; each left symbol joins a right one after it."""
        right = (mixed(self.name, 50 + turn) >> np.uint64(63)).astype(bool)
        joins = np.append(False, ~right[:-1] & right[1:] & (self.row[1:] == self.row[:-1]))[: len(self.name)]
        takes = np.append(joins[1:], False)
        following = np.append(self.name[1:], np.uint64(0))[: len(self.name)]
        name = np.where(takes, mixed(mixed(self.name, 60 + turn) + following, 41), self.name)
        return self.joined(joins, name[~joins], end)


def recompressed(hashes: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    out = Symbols.of_words(hashes, rows)
    for turn in range(rounds):
        out = out.runs(len(hashes)).pairs(turn, len(hashes))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        size += step
    return values


@dataclass
class Windows:
    """Windows of many texts: first word, row, and the place that each picked (-1: none)."""

    start: np.ndarray
    row: np.ndarray
    place: np.ndarray
    key: np.ndarray  # per word position: the name of a place there
    hashes: np.ndarray
    rows: np.ndarray


def windows_of(hashes: np.ndarray, rows: np.ndarray, k: int = WINDOW, radius: int = RADIUS) -> Windows:
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    start = np.repeat(rows[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(np.arange(len(counts)), counts)
    none = np.iinfo(np.int64).max
    around = rolling(hashes, 2 * radius)
    key = np.zeros(len(hashes) + 1, np.uint64)
    if not len(start):
        return Windows(start, row, start, key, hashes, rows)
    key[radius : radius + len(around)] = around
    symbols = recompressed(hashes, rows)
    deep = (symbols.start - symbols.low <= radius) & (symbols.high - symbols.start <= radius)
    at = symbols.start[deep]
    at = at[(at >= radius) & (at + radius <= len(hashes))]
    order = np.full(len(hashes) + 1, none)
    order[at] = ((mixed(key[at], 71) >> np.uint64(33)).astype(np.int64) << 32) | at
    least = sliding_least(order, k - 2 * radius + 1)[start + radius]
    return Windows(start, row, np.where(least == none, -1, least & 0xFFFFFFFF), key, hashes, rows)


def _per_text(batch: pa.RecordBatch, k: int):
    """(first row, rows, bytes, word table) of each numpy step over a batch."""
    flat, offsets = text_bytes(batch.column(1))
    for a, b in slices(np.diff(offsets)):
        own, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, starts, ends, rows = word_hashes(own, bounds)
        yield a, b, own, (starts, ends), windows_of(hashes, rows, k)


def places(docs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(key, row key, at): the picked places of every document with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in keys]
            for a, _, _, _, w in _per_text(batch, k):
                at, which = np.unique(w.place, return_index=True)
                at, which = at[at >= 0], which[at >= 0]
                row = w.row[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.key[at].view(np.int64)), *[pa.array(x[a + row]) for x in ids], pa.array((at - w.rows[row]).astype(np.int32))],
                    ["key", *keys, "at"],
                )

    return docs.mapInArrow(run, f"key long, {' long, '.join(keys)} long, at int")


def _candidates(w: Windows, unique: pa.Array, a: int, b: int) -> np.ndarray:
    """Indexes of the windows whose place is not unique; ``unique`` lists the unique places of each row."""
    part = unique.slice(a, b - a)
    sizes = part.value_lengths().fill_null(0).to_numpy()
    once = np.zeros(len(w.hashes) + 1, bool)
    once[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.rows[:-1], sizes)] = True
    return np.flatnonzero((w.place < 0) | ~once[w.place])


def _names(w: Windows, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints of each chosen window, and which of them come first in their row."""
    one, two = (rolling(w.hashes, k, which)[w.start[chosen]] if len(chosen) else np.empty(0, np.uint64) for which in (0, 1))
    order = np.lexsort((chosen, two, one, w.row[chosen]))
    same = np.append(False, (np.diff(w.row[chosen][order]) == 0) & (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0))[: len(order)]
    first = np.zeros(len(chosen), bool)
    first[order[~same]] = True
    return one, two, first


def candidate_windows(docs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(one, two, row key, start): fingerprints of the candidate windows, each once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in keys]
            for a, b, _, _, w in _per_text(batch, k):
                chosen = _candidates(w, batch.column("unique"), a, b)
                one, two, first = _names(w, chosen, k)
                row = w.row[chosen][first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[first].view(np.int64)), pa.array((two[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        *[pa.array(x[a + row]) for x in ids], pa.array((w.start[chosen][first] - w.rows[row]).astype(np.int32)),
                    ],
                    ["one", "two", *keys, "start"],
                )

    return docs.mapInArrow(run, f"one long, two int, {' long, '.join(keys)} long, start int")


def without_repeats(docs: DataFrame, k: int) -> DataFrame:
    """Applies the decisions: (doc_id, n_words, n_removed, kept_sha256, kept_text)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own, (starts, ends), w in _per_text(batch, k):
                chosen = _candidates(w, batch.column(2), a, b)
                _, _, first = _names(w, chosen, k)
                part = batch.column(3).slice(a, b - a)
                sizes = part.value_lengths().fill_null(0).to_numpy()
                earliest = np.zeros(len(w.hashes) + 1, bool)
                earliest[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.rows[:-1], sizes)] = True
                later = w.start[chosen[~(first & earliest[w.start[chosen]])]]
                edges = np.bincount(later, minlength=len(w.hashes) + 1) - np.bincount(later + k, minlength=len(w.hashes) + 1)
                gone = np.cumsum(edges)[: len(w.hashes)] > 0
                kept, sums = [], np.append(0, np.cumsum(gone))[w.rows]
                for lo, hi in zip(w.rows[:-1].tolist(), w.rows[1:].tolist()):
                    left = np.flatnonzero(~gone[lo:hi]) + lo
                    kept.append(b" ".join([own[s:e].tobytes() for s, e in zip(starts[left].tolist(), ends[left].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(w.rows), pa.int64()), pa.array(np.diff(sums), pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in kept]), pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``k`` words covers it that also starts earlier: in a document of smaller id, or earlier
    in the same one. Windows are judged on the input.
    """
    if k < 2 * RADIUS + 2:
        raise ValueError(f"windows have at least {2 * RADIUS + 2} words")
    texts, keys = keyed_texts(docs, NO_ID)
    named = places(texts, k, keys).groupBy("key").agg(F.count(F.lit(1)).alias("times"), *[F.min(c).alias(c) for c in [*keys, "at"]])
    unique = named.where("times = 1").groupBy(*keys).agg(F.collect_list("at").alias("unique"))
    # always by a shuffle on the key: the two passes below read the same exchange of texts
    known = texts.join(unique.hint("merge"), keys, "left").select("doc_id", "text", *keys[1:], "unique")
    windows = candidate_windows(known, k, keys).groupBy("one", "two").agg(*earliest(keys, "start"))
    first = windows.groupBy(*keys).agg(F.collect_list("start").alias("first"))
    out = without_repeats(known.join(first.hint("merge"), keys, "left").select("doc_id", "text", "unique", "first"), k)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
