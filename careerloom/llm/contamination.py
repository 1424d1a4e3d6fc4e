"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of whole documents, and each segment's index is stored: for every term the
list of word numbers at which it stands, and for every document its first word number. The index knows nothing of the
benchmark. Windows of the benchmark are looked up in it: term counts over the whole index order the terms of a window
from the rarest on; a window goes to the segments that hold its rarest term, and only there its lists are intersected,
each shifted by the term's offset in the window, rarest first. What is left are exact phrase matches. A place of the
rarest term with all other terms within ``REACH`` words of it, in any order, is a proximity match.

A segment is the unit of work, so a term that a third of all words are is spread over all segments. Windows with a
term that no document has are dropped first; equal windows are looked up once. Sets of items that share a window are
named by a fingerprint, and the list of item ids is made once for each distinct combination of sets.

Null and wordless documents have no words and no hits; null and wordless items have no windows. Repeated documents are
separate rows; items that share an id are one item; a null item id hits words and counts as an item, but has no place in
the list of ids. Empty tables give empty or unhit results. Extra columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import LOWER, sha_hex, slices, spans_of, stored, term_lists, text_bytes
from careerloom.operators.relational import enrich

#: Words of a window, and words on either side in which a proximity match has all terms.
WINDOW, REACH = 10, 20
#: Bytes of text of a segment (a longer document is one of its own), and match candidates held at a time.
SEGMENT_BYTES, CANDIDATES = 1 << 22, 1 << 19
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Rows with a term are posting lists (``places``: 32-bit steps between word numbers); rows without are documents.
INDEX = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("places", pa.binary()),
    ("doc_id", pa.int64()), ("first", pa.int32()), ("n_words", pa.int64()),
])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = TaskContext.get().partitionId() << 32
    for batch in batches:
        flat, offsets = text_bytes(batch.column("text"))
        for lo, hi in slices(np.diff(offsets), SEGMENT_BYTES):
            part = LOWER[flat[offsets[lo] : offsets[hi]]]
            terms, begins, places, rows = term_lists(part, offsets[lo : hi + 1] - offsets[lo], _NOT_WORD)
            steps = np.diff(places, prepend=0)
            steps[begins[:-1]] = places[begins[:-1]]
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(steps.astype("<i4"))])
            nones = lambda kind, n: pa.nulls(n, kind)
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, segment)), terms, pa.array(np.diff(begins).astype(np.int32)), lists, nones(pa.int64(), n), nones(pa.int32(), n), nones(pa.int64(), n)],
                schema=INDEX,
            )
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, segment)), nones(pa.string(), n), nones(pa.int32(), n), nones(pa.binary(), n),
                    batch.column("doc_id").slice(lo, n), pa.array(rows[:-1].astype(np.int32)), pa.array(np.diff(rows)),
                ],
                schema=INDEX,
            )
            segment += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored positional index of ``docs`` (doc_id, text)."""
    kinds = "segment long, term string, n int, places binary, doc_id long, first int, n_words long"
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segments, kinds)
    return stored(made, "positional-index", compression="zstd")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words) of every window of ``items`` (item_id, text), once per item."""
    words = F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))
    split = items.select("item_id", words.alias("words")).where(F.size("words") > 0)
    return split.select("item_id", F.explode(F.when(F.size("words") > size, cut).otherwise(F.array("words"))).alias("words")).distinct()


def _set_name() -> list:
    """Count and two combined fingerprints of the items of a window; null ids count."""
    item = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    return [F.count(F.lit(1)).alias("items"), F.bit_xor(item).alias("mix"), F.sum(item.cast("decimal(20,0)")).alias("sum")]


def _by_rarity(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(terms, at, size, set) of every window whose terms all occur: its distinct places from the rarest term on."""
    terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "window-terms")
    frequency = index.where("term is not null").select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    places = windows.select("words", "set", F.posexplode("words").alias("at", "term")).join(frequency, "term")
    spec = places.groupBy("words", "set").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("spec"))
    whole = spec.where(F.size("spec") == F.size("words"))
    return stored(whole.select(F.col("spec.term").alias("terms"), F.col("spec.at").alias("at"), "set"), "windows-by-rarity")


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_near", pa.int64()),
    ("spans", pa.list_(pa.list_(pa.int32()))), ("sets", pa.list_(pa.int64())),
])


class Lists:
    """The posting lists of one segment, as one sorted array of (term number, place)."""

    def __init__(self, table: pa.Table) -> None:
        self.terms = table.column("term").combine_chunks()
        data = table.column("places").combine_chunks().cast(pa.large_binary())
        self.n = table.column("n").to_numpy().astype(np.int64)
        steps = np.frombuffer(b"".join(data.to_pylist()), "<i4").astype(np.int64)
        begins = np.cumsum(self.n) - self.n
        sums = np.cumsum(steps)
        before = np.where(begins > 0, sums[begins - 1], 0) if len(steps) else begins
        self.places = sums - np.repeat(before, self.n)
        self.begins = begins
        self.keys = np.repeat(np.arange(len(self.n)), self.n) << 32 | self.places

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of a term has a place from ``low`` to ``high``."""
        at = np.searchsorted(self.keys, term << 32 | low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32 | high))


def _looked_up(reach: int, candidates: int):
    def look_up(index: pa.Table, windows: pa.Table) -> pa.Table:
        is_doc = pc.is_null(index.column("term"))
        docs = index.filter(is_doc).sort_by([("first", "ascending"), ("n_words", "ascending")])
        first, n_words = docs.column("first").to_numpy().astype(np.int64), docs.column("n_words").to_numpy()
        total = int(n_words.sum())
        hit, near, found = np.zeros(total + 1, np.int64), np.zeros(total, bool), np.empty((0, 2), np.int64)
        lists = Lists(index.filter(pc.invert(is_doc)))
        if windows.num_rows and len(lists.n):
            flat = windows.column("terms").combine_chunks()
            size = flat.value_lengths().to_numpy().astype(np.int64)
            width = int(size.max())
            slot = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            term, at = np.zeros((len(size), width), np.int64), np.zeros((len(size), width), np.int64)
            term[slot] = pc.fill_null(pc.index_in(flat.flatten(), value_set=lists.terms), -1).to_numpy()
            at[slot] = windows.column("at").combine_chunks().flatten().to_numpy()
            sets = windows.column("set").to_numpy()
            present = np.flatnonzero((term >= 0).all(axis=1))
            times = lists.n[term[present, 0]]
            for lo, hi in slices(times, candidates):
                w = np.repeat(present[lo:hi], times[lo:hi])
                n = times[lo:hi]
                seed = lists.places[np.repeat(lists.begins[term[present[lo:hi], 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                doc = np.searchsorted(first, seed, side="right") - 1
                low, high = first[doc], first[doc] + n_words[doc] - 1
                start = seed - at[w, 0]
                stays = (start >= low) & (start + size[w] - 1 <= high)
                close = np.ones(len(w), bool)
                for k in range(1, width):
                    own = k < size[w]
                    live = np.flatnonzero(stays & own)
                    place = start[live] + at[w[live], k]
                    stays[live] = lists.has(term[w[live], k], place, place)
                    live = np.flatnonzero(close & own)
                    close[live] = lists.has(term[w[live], k], np.maximum(seed[live] - reach, low[live]), np.minimum(seed[live] + reach, high[live]))
                near[seed[close]] = True
                np.add.at(hit, start[stays], 1)
                np.add.at(hit, start[stays] + size[w[stays]], -1)
                found = np.unique(np.concatenate([found, np.stack([doc[stays], sets[w[stays]]], axis=1)]), axis=0)
        covered = np.cumsum(hit[:total]) > 0
        upto = lambda flags: np.append(0, np.cumsum(flags))
        count = lambda flags: upto(flags)[first + n_words] - upto(flags)[first]
        n_hit, n_near = count(covered), count(near & ~covered)
        spans = [(spans_of(covered[a : a + n]).tolist() if h else []) for a, n, h in zip(first, n_words, n_hit)]
        owner = np.searchsorted(found[:, 0], np.arange(len(first) + 1))
        of_doc = pa.ListArray.from_arrays(pa.array(owner.astype(np.int32)), pa.array(found[:, 1]))
        return pa.table([docs.column("doc_id"), docs.column("n_words"), pa.array(n_hit), pa.array(n_near), pa.array(spans, _FOUND.field("spans").type), of_doc], schema=_FOUND)

    return look_up


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, reach: int = REACH, candidates: int = CANDIDATES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, spans) of every row of ``docs`` (doc_id, text).

    ``spans`` has the [from, to) word numbers of the parts that are hit, ``n_near`` the number of words where a proximity
    match without a phrase match stands. ``items`` has (item_id, text).
    """
    return look_up(build_index(docs), items, size, reach, candidates)


def look_up(index: DataFrame, items: DataFrame, size: int = WINDOW, reach: int = REACH, candidates: int = CANDIDATES) -> DataFrame:
    """The same over an index that ``build_index`` stored; it serves any number of benchmarks."""
    by_item = stored(windows_of(items, size), "windows")
    windows = by_item.groupBy("words").agg(*_set_name()).select("words", F.xxhash64("items", "mix", "sum").alias("set"))
    windows = stored(windows, "distinct-windows")
    ranked = _by_rarity(windows, index)

    # windows go to the segments with their rarest term; lists of window terms go to their segments, documents with them
    seeds = ranked.select(F.element_at("terms", 1).alias("term"), "terms", "at", "set")
    sent = index.where("term is not null").select("segment", "term").join(seeds, "term").select(F.col("segment").alias("target"), "terms", "at", "set")
    terms = ranked.select(F.explode("terms").alias("term")).distinct()
    lists = index.where("term is not null").join(terms, "term", "left_semi").unionByName(index.where("term is null"))
    found = lists.groupBy("segment").cogroup(sent.groupBy("target")).applyInArrow(
        _looked_up(reach, candidates), "doc_id long, n_words long, n_hit long, n_near long, spans array<array<int>>, sets array<long>"
    )
    found = stored(found, "matches").withColumn("key", F.when(F.size("sets") > 0, F.sha2(F.array_join("sets", ",").cast("binary"), 256)))

    shown = windows.groupBy("set").agg(F.min("words").alias("words"))
    members = shown.join(by_item, "words").select("set", "item_id")
    kinds = found.where("key is not null").groupBy("key").agg(F.first("sets").alias("sets"))
    ids = kinds.select("key", F.explode("sets").alias("set")).join(members, "set").select("key", "item_id").distinct()
    lists = ids.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), sha_hex(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",")).alias("items_sha256")
    )
    out = enrich(found, stored(lists, "item-lists"), "key")
    return out.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", sha_hex(F.lit(""))).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near", "spans",
    )
