"""Suffix-array dedup over bytes: strings of k bytes that occur more than once are removed.

Not every suffix is sorted. Each string of k bytes picks an anchor inside itself, the 16-byte gram of least
fingerprint; equal strings pick the same at the same offset. So the starts of strings fall into classes, by anchor and
by a range of offsets, and strings can only be equal within the classes that share a ``core``, the bytes that all
strings of the class hold. Spark counts cores over all documents and drops those that occur once. Of the rest,
classes that are equal in every byte are repeats as they stand. The others, one of each kind, are laid out in text
order, their starts are brought into suffix order by doubling, and each start's longest previous and next factor, cut
at k bytes, is read off its neighbours: among equal prefixes suffix order is text order, so the previous smaller
position is the one before and the next the one after. Cores with very many kinds are compared start by start by a
Spark aggregate instead, so no task holds an unbounded group.

Null text counts as empty. Each row is a text of its own, also where ids repeat, so a repeated row repeats all strings of
the first. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import earliest, keyed_texts, mixed, powers, slices, spans_of, stored, text_bytes
from careerloom.llm.recompression import NO_ID, sliding_least

#: Bytes of a string, of an anchor gram, and ranges that offsets are put in.
WINDOW, GRAM, RANGES = 400, 16, 4
#: Kinds of one core that a task sorts; cores with more are compared start by start.
MOST_KINDS = 2048
#: Bytes that a task brings into suffix order at a time.
SORT_BYTES = 1 << 20


def prefix_sums(flat: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of byte values times powers; ``interval`` reads fingerprints from them."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    values = mixed(np.arange(256, dtype=np.uint64), 80 + which)
    np.cumsum(values[flat] * powers(len(flat), which)[0], out=sums[1:])
    return sums


def interval(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of the bytes from ``start`` to ``end``."""
    down = powers(len(sums), which)[1]
    return mixed((sums[end] - sums[start]) * down[start] + mixed((end - start).astype(np.uint64), 90), 91)


@dataclass
class Classes:
    """Classes of string starts: row, anchor and range; first and last start; fingerprints of the core and of all bytes."""

    row: np.ndarray
    code: np.ndarray  # anchor position in the row times the ranges, plus the range
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    whole: np.ndarray


def classes_of(flat: np.ndarray, offsets: np.ndarray, k: int = WINDOW) -> Classes:
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = k - GRAM + 1
    if not len(start):
        empty = np.empty(0, np.int64)
        return Classes(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    sums = prefix_sums(flat)
    at = np.arange(len(flat) - GRAM + 1)
    down = powers(len(sums), 0)[1]
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(at)], 92)
    anchor = sliding_least(((gram >> np.uint64(33)).astype(np.int64) << 32) | at, width)[start] & 0xFFFFFFFF
    step = -(-width // RANGES)
    part = (anchor - start) // step
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(row) != 0)))
    low, high = start[new], start[np.append(new[1:], len(start)) - 1]
    anchor, part, row = anchor[new], part[new], row[new]
    core = interval(sums, anchor - part * step, anchor + k - np.minimum((part + 1) * step - 1, width - 1))
    core = mixed(core, 93) + part.astype(np.uint64)
    whole = interval(sums, low, high + k) ^ mixed(((anchor - low) * 4096 + (anchor - high)).astype(np.uint64), 94)
    return Classes(row, (anchor - offsets[row]) * RANGES + part, low, high, core, whole)


def _per_text(batch: pa.RecordBatch, k: int):
    flat, offsets = text_bytes(batch.column(1))
    for a, b in slices(np.diff(offsets)):
        own, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, own, bounds, classes_of(own, bounds, k)


def class_rows(docs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(core, whole, row key, code, times): the classes of every document, equal ones of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in keys]
            for a, _, _, _, c in _per_text(batch, k):
                order = np.lexsort((c.code, c.whole, c.core, c.row))
                row, core, whole = c.row[order], c.core[order], c.whole[order]
                new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(core) != 0) | (np.diff(whole) != 0))[: len(order)])
                times = np.diff(np.append(new, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[new].view(np.int64)), pa.array(whole[new].view(np.int64)), *[pa.array(x[a + row[new]]) for x in ids], pa.array(c.code[order][new].astype(np.int64)), pa.array(times.astype(np.int32))],
                    ["core", "whole", *keys, "code", "times"],
                )

    return docs.mapInArrow(run, f"core long, whole long, {' long, '.join(keys)} long, code long, times int")


def texts_of_kinds(docs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(core, row key, code, single, many, bytes): the bytes of each kind that ``docs`` (doc_id, text, kinds) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed = [batch.column(c).to_pylist() for c in keys], batch.column("kinds").to_pylist()
            for a, _, own, bounds, c in _per_text(batch, k):
                place = {(r, code): i for i, (r, code) in enumerate(zip(c.row.tolist(), c.code.tolist()))}
                out: list[tuple] = []
                for r in range(len(bounds) - 1):
                    for kind in listed[a + r] or ():
                        i = place[r, kind["code"]]
                        out.append((kind["core"], *[x[a + r] for x in ids], kind["code"], kind["single"], kind["many"], own[c.low[i] : c.high[i] + k].tobytes()))
                types = [pa.int64(), *[pa.int64()] * len(keys), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
                cols = list(zip(*out)) if out else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["core", *keys, "code", "single", "many", "bytes"])

    return docs.mapInArrow(run, f"core long, {' long, '.join(keys)} long, code long, single boolean, many boolean, bytes binary")


def suffix_order(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their first ``depth`` bytes, ties in text order, and whether each equals the one before.

    Prefix doubling: ranks of 2^i bytes come from pairs of ranks of half as many.
    """
    padded = np.append(flat, np.zeros(depth + 8, np.uint8)).astype(np.uint64)
    n = len(flat) + depth
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    reach = 8
    while reach * 2 <= depth:
        following = np.append(rank[reach:], np.zeros(reach, np.int64))
        rank = np.unique((rank << 32) | following, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    final = (rank[starts] << 32) | rank[starts + depth - reach]
    order = np.lexsort((starts, final))
    return order, np.append(False, np.diff(final[order]) == 0)[: len(order)]


def repeated_starts(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text, whether the string of ``k`` bytes at each start also starts anywhere else in the texts."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    counts = sizes - k + 1
    first = np.cumsum(counts) - counts
    starts = np.repeat(begins - first, counts) + np.arange(counts.sum())
    order, as_before = suffix_order(flat, starts, k)
    previous, following = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    previous[order] = as_before  # the longest previous factor reaches k bytes
    following[order] = np.append(as_before[1:], False)
    return np.split(previous | following, first[1:])


def sorted_hits(kinds: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(row key, code, low, high): runs of repeated starts in the single kinds, counted from the first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sort() -> pa.RecordBatch:
            out = []
            for (_, *doc, code, single, _), hit in zip(held, repeated_starts([h[-1] for h in held], k)):
                if single and hit.any():
                    out += [(*doc, code, int(lo), int(hi)) for lo, hi in spans_of(hit)]
            held.clear()
            names = [*keys, "code", "low", "high"]
            cols = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names)

        size = 0
        for batch in batches:
            for kind in zip(*[c.to_pylist() for c in batch.columns]):
                if held and size > SORT_BYTES and kind[0] != held[-1][0]:  # a core stays together
                    yield sort()
                    size = 0
                held.append(kind)
                size += len(kind[-1])
        if held:
            yield sort()

    rows = kinds.select("core", *keys, "code", "single", "bytes").repartition("core").sortWithinPartitions("core")
    return rows.mapInArrow(run, f"{' long, '.join(keys)} long, code long, low long, high long")


def counted_hits(kinds: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The same for cores of very many kinds: each start is a row, and an aggregate finds the fingerprints that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *doc, code, single, data in zip(*[c.to_pylist() for c in batch.columns]):
                flat = np.frombuffer(data, np.uint8)
                at = np.arange(len(flat) - k + 1)
                one, two = (interval(prefix_sums(flat, w), at, at + k, w).view(np.int64) for w in (0, 1))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), *[pa.array(np.full(n, x)) for x in doc], pa.array(np.full(n, code)), pa.array(at), pa.array(np.full(n, single))],
                    ["one", "two", *keys, "code", "at", "single"],
                )

    rows = kinds.select("core", *keys, "code", "single", "bytes").mapInArrow(run, f"one long, two long, {' long, '.join(keys)} long, code long, at long, single boolean")
    rows = stored(rows, "starts")
    often = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("one", "two")
    return rows.where("single").join(often, ["one", "two"], "left_semi").select(*keys, "code", F.col("at").alias("low"), (F.col("at") + 1).alias("high"))


def without_repeats(docs: DataFrame, k: int) -> DataFrame:
    """Applies the decisions to (doc_id, text, repeated, hits): the result rows, with the kept bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own, bounds, c in _per_text(batch, k):
                wholes, hits = batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist()
                rows = np.searchsorted(c.row, np.arange(b - a + 1))
                out: list[tuple] = []
                for r in range(b - a):
                    size = int(bounds[r + 1] - bounds[r])
                    steps = np.zeros(size + 1, np.int64)
                    mine = slice(rows[r], rows[r + 1])
                    low, high = c.low[mine] - bounds[r], c.high[mine] - bounds[r]
                    if wholes[r]:
                        of = np.isin(c.whole[mine].view(np.int64), np.array(wholes[r], np.int64))
                        np.add.at(steps, low[of], 1)
                        np.add.at(steps, high[of] + k, -1)
                    if hits[r]:
                        first = dict(zip(c.code[mine].tolist(), low.tolist()))
                        for hit in hits[r]:
                            steps[first[hit["code"]] + hit["low"]] += 1
                            steps[first[hit["code"]] + hit["high"] - 1 + k] -= 1
                    gone = np.cumsum(steps)[:size] > 0
                    kept = own[bounds[r] : bounds[r + 1]][~gone].tobytes()
                    out.append((size, int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x, t) for x, t in zip(cols, types)]], names)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, k: int = WINDOW, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A byte goes if it lies in a string of ``k`` bytes that also starts anywhere else; strings are judged on the input.
    """
    texts, keys = keyed_texts(docs, NO_ID)
    rows = stored(class_rows(texts, k, keys), "classes")
    cores = rows.groupBy("core").agg(F.sum("times").alias("times")).where("times > 1").select("core")
    shared = stored(rows.join(cores.hint("merge"), "core", "left_semi"), "shared")
    kinds = shared.groupBy("core", "whole").agg(F.sum("times").alias("times"), *earliest(keys, "code"))
    kinds = stored(kinds, "kinds")
    mixed_cores = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    to_compare = kinds.join(mixed_cores.hint("merge"), "core").select(
        *keys, F.struct("core", "code", (F.col("times") == 1).alias("single"), (F.col("kinds") > most_kinds).alias("many")).alias("kind")
    )
    repeated = shared.join(kinds.where("times > 1").select("core", "whole").hint("merge"), ["core", "whole"], "left_semi")
    by_doc = stored(
        to_compare.groupBy(*keys).agg(F.collect_list("kind").alias("kinds")).join(
            repeated.groupBy(*keys).agg(F.collect_set("whole").alias("repeated")).hint("merge"), keys, "full"
        ), "by-doc",
    )
    known = texts.join(by_doc.hint("merge"), keys, "left").select(*keys, "text", "kinds", "repeated")
    compared = stored(texts_of_kinds(known.where("kinds is not null").select("doc_id", "text", *keys[1:], "kinds"), k, keys), "kind-texts")
    hits = sorted_hits(compared.where("not many"), k, keys).unionByName(counted_hits(compared.where("many"), k, keys))
    hits = hits.groupBy(*keys).agg(F.collect_list(F.struct("code", "low", "high")).alias("hits"))
    out = without_repeats(known.join(hits.hint("merge"), keys, "left").select("doc_id", "text", "repeated", "hits"), k)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
