"""Helpers shared by the operators of this subpackage: tokens, fingerprints, folders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerloom.session import stored

__all__ = ["stored", "read", "keyed_texts", "numbered", "held_out", "words_text", "slices", "word_hashes", "mixed", "rolling", "sha_hex", "spans_of"]

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4: rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keyed_texts(docs: DataFrame, no_id: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, text) with ``no_id`` for null ids, and the columns that name a row's text.

    These are the id, and, if rows share an id but not the text, also ``tag``, a digest of the text. Equal rows share
    their key.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)).alias("doc_id"), "text")
    shared = texts.select("doc_id", digest.alias("tag")).groupBy("doc_id").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    if shared.where("lo <> hi").isEmpty():
        return texts, ["doc_id"]
    return texts.withColumn("tag", digest), ["doc_id", "tag"]


def earliest(keys: list[str], place: str) -> list[Column]:
    """Aggregates for the least key and its ``place``."""
    order = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return [F.min(keys[0]).alias(keys[0]), *[F.min_by(c, order).alias(c) for c in [*keys[1:], place]]]


def numbered(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """``docs`` with a number ``_row`` of each row's own, the same for every reader.

    Rows are numbered and stored. With ``from_files``, for a table just read, whose rows are rows of its files, the
    number is made of file and place in the file, so nothing is copied; the table of files has one row per file. An
    exploded table must not say so: its rows share their places.
    """
    try:
        if not from_files:
            return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    files = stored(files.withColumn("_nth", F.row_number().over(Window.orderBy("_file"))), "files")
    row = F.shiftleft(F.col("_nth").cast("long"), 40) + F.col("_place")
    return placed.join(files, "_file").withColumn("_row", row).drop("_file", "_place", "_nth")


def slices(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) row ranges of at most ``most`` bytes, or of one row."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0], offsets - (offsets[0] if len(offsets) else 0)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(n, 1 << 16), _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            both.append(out)
        have = _POWERS[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = mixed(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes with A-Z lower-cased; taken by ``LOWER[flat]``.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(flat: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words of many texts: (hashes, starts, ends, first word of each row, and one past the last).

    Words are maximal runs of bytes that are not ``blank`` (the six ASCII blanks at least); a word never crosses a row.
    """
    n = len(flat)
    inside = np.zeros(n + 1, bool)
    np.logical_not(blank[flat], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[:n][edges]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts, rows
    closes = np.zeros(n, bool)
    closes[: n - 1] = inside[: n - 1] & (~inside[1:n] | begins[1:n])
    closes[n - 1] = inside[n - 1]
    ends = np.flatnonzero(closes) + 1
    up, down = powers(n)
    sums = np.add.reduceat(np.where(blank, np.uint64(0), _byte_values())[flat] * up, starts)
    return mixed(sums * down[starts]), starts, ends, rows


def substrings(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String array of the byte ranges of ``flat``."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    data = flat[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).cast(pa.string())


def term_lists(flat: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of many texts and where they stand: (terms, list starts, places, first word of each row).

    ``places`` has the numbers of all words, grouped by term and ascending within one; ``list starts`` has one entry
    more than there are terms.
    """
    hashes, starts, ends, rows = word_hashes(flat, offsets, blank)
    places = np.argsort(hashes, kind="stable")
    ranked = hashes[places]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
    first = places[begins]
    return substrings(flat, starts[first], ends[first]), np.append(begins, len(places)), places, rows


def rolling(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Fingerprint of every ``k`` consecutive values (rows are not told apart)."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers(n, which)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(values, 11 + which) * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1], 23 + which)


def spans_of(covered: np.ndarray) -> np.ndarray:
    """(start, end) of each maximal run of true values."""
    steps = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1)


def sha_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def words_text(text: str = "text") -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
