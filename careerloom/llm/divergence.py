"""Source divergence audit: hash-consed segment trees over term ids, priced two at a time.

Terms are counted per (lang, source) in one pass; each language keeps the terms of at least ``LEAST_DOCS`` of its
documents and numbers them in order. The term numbers are cut into blocks of ``BLOCK``. In a block every group has a
segment tree over its counts. Nodes are hash-consed: equal count subtrees, of one group or of several, are one node, so
a node is named by the pair of its children. Two trees are walked together from their roots; each pair of nodes is met
once per level however often it occurs, and is priced once, from its children's prices. Spark adds the blocks.

A unit of work is one block for two sets of at most ``SOURCES`` groups, so neither the vocabulary nor the groups of a
language gather in one task. One row per pair of groups is what the audit returns, and all it emits.

Null text, lang and source count as ''. Texts without terms still make their group occur. Repeated rows are separate
documents. A language without kept terms has pairs of value 0 and no term rows. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import LOWER, slices, stored, term_lists, text_bytes
from careerloom.llm.mixing import running_sum

#: Documents of a language that must hold a term, and ranks of the term part.
LEAST_DOCS, TOP_TERMS = 30, 50
#: A probability is 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
SCALE, PRIOR = 1_000_000_000, 5
#: Terms of a block, groups on either side of a unit, and bytes of text counted at a time.
BLOCK, SOURCES, STEP = 4096, 32, 1 << 22

_NOT_TERM = np.zeros(256, bool)
_NOT_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names = pa.table([group.field(0), group.field(1)], ["lang", "source"]).group_by(["lang", "source"], use_threads=False).aggregate([])
        at = {(a, b): i for i, (a, b) in enumerate(zip(*[names.column(c).to_pylist() for c in ("lang", "source")]))}
        groups = np.array([at[a, b] for a, b in zip(group.field(0).to_pylist(), group.field(1).to_pylist())], np.int64)
        flat, offsets = text_bytes(batch.column("text"))
        for lo, hi in slices(np.diff(offsets), STEP):
            part = LOWER[flat[offsets[lo] : offsets[hi]]]
            terms, begins, places, rows = term_lists(part, offsets[lo : hi + 1] - offsets[lo], _NOT_TERM)
            row = np.searchsorted(rows, places, side="right") - 1
            term = np.repeat(np.arange(len(terms)), np.diff(begins))
            # places ascend within a term, so the words of one document are neighbours
            new = np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))[: len(term)]
            kinds = len(at)
            key, where = np.unique(term * kinds + groups[lo:hi][row], return_inverse=True)
            count = np.bincount(where, minlength=len(key)).astype(np.int64)
            docs = np.bincount(where[new], minlength=len(key)).astype(np.int64)
            owner = pa.array(key % kinds)
            yield pa.RecordBatch.from_arrays(
                [*[names.column(c).combine_chunks().take(owner) for c in ("lang", "source")], terms.take(pa.array(key // kinds)), pa.array(count), pa.array(docs)],
                ["lang", "source", "term", "n", "n_docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents with the term, per group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """The scaled probability, in exact arithmetic."""
    return F.expr(f"1 + ({SCALE} * cast({count} + {PRIOR} as decimal(28, 0))) div ({total} + {PRIOR} * {terms})")


class Trees:
    """Hash-consed segment trees, one per row of ``counts`` (its width a power of two; -1 where there is no term)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.leaves, node = np.unique(counts, return_inverse=True)
        node = node.reshape(counts.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        kinds = len(self.leaves)
        while node.shape[1] > 1:
            left, right = node[:, ::2], node[:, 1::2]
            pairs, parent = np.unique(left * kinds + right, return_inverse=True)
            self.levels.append((*np.divmod(pairs, kinds), kinds))
            node, kinds = parent.reshape(left.shape), len(pairs)
        self.root = node[:, 0]

    def distance(self, a: int, b: int, price_a: np.ndarray, price_b: np.ndarray) -> int:
        """Sum over the leaves of the difference of the two prices; prices are given per distinct leaf."""
        here, there = self.root[[a]], self.root[[b]]
        met = []
        for left, right, kinds in reversed(self.levels):
            both = np.concatenate([left[here] * kinds + left[there], right[here] * kinds + right[there]])
            pairs, where = np.unique(both, return_inverse=True)
            here, there = np.divmod(pairs, kinds)
            met.append(where)
        price = np.abs(price_a[here] - price_b[there])
        for where in reversed(met):
            half = len(where) // 2
            price = price[where[:half]] + price[where[half:]]
        return int(price[0])


def leaf_prices(leaves: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The scaled probability of each distinct count; 0 where there is no term."""
    if len(leaves) and int(leaves[-1]) + PRIOR < (1 << 62) // SCALE:
        price = 1 + SCALE * (leaves + PRIOR) // max(1, total + PRIOR * terms)
    else:
        price = np.array([1 + SCALE * (int(c) + PRIOR) // (total + PRIOR * terms) for c in leaves], np.int64)
    return np.where(leaves < 0, 0, price)


_PRICED = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def _priced(lang: str, low: int, high: int, table: pa.Table, block_terms: int, sources: int) -> pa.Table:
    """Prices of all pairs between two sets of groups, in one block of terms."""
    at, place, n = (table.column(c).to_numpy() for c in ("at", "place", "n"))
    groups, first, tree = np.unique(at, return_index=True, return_inverse=True)
    totals, (terms, block) = table.column("total").to_numpy()[first], (table.column(c)[0].as_py() for c in ("terms", "block"))
    width = min(block_terms, terms - block * block_terms)
    if width <= 0:
        trees, prices = None, None
    else:
        counts = np.zeros((len(groups), 1 << (width - 1).bit_length()), np.int64)
        counts[:, width:] = -1
        real = place >= 0
        counts[tree[real], place[real]] = n[real]
        trees = Trees(counts)
        prices = [leaf_prices(trees.leaves, int(t), terms) for t in totals]
    part = groups // sources
    pairs = [(i, j) for i in np.flatnonzero(part == low) for j in np.flatnonzero(part == high) if groups[i] < groups[j]]
    value = [trees.distance(i, j, prices[i], prices[j]) if trees else 0 for i, j in pairs]
    return pa.table(
        [pa.array([lang] * len(pairs), pa.string()), pa.array([groups[i] for i, _ in pairs], pa.int32()), pa.array([groups[j] for _, j in pairs], pa.int32()), pa.array(value, pa.int64())],
        schema=_PRICED,
    )


def _pair_values(used: DataFrame, groups: DataFrame, block: int, sources: int) -> DataFrame:
    """(lang, a, b, value) of every two groups of a language, a < b by their numbers."""
    whole = groups.select("lang", "source", "at", "parts", "total", "terms")
    cells = used.join(whole, ["lang", "source"]).select(
        "lang", "at", "parts", "total", "terms", F.floor(F.col("id") / block).cast("int").alias("block"), (F.col("id") % block).cast("int").alias("place"), "n"
    )
    last = F.greatest(F.lit(0), F.floor((F.col("terms") - 1) / block).cast("int"))
    every = whole.select(
        "lang", "at", "parts", "total", "terms", F.explode(F.sequence(F.lit(0), last)).alias("block"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("n")
    )
    part = F.floor(F.col("at") / sources).cast("int")
    units = cells.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("*", F.least(part, "other").alias("low"), F.greatest(part, "other").alias("high"))

    def price(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        return _priced(lang, low, high, table, block, sources)

    priced = units.groupBy("lang", "block", "low", "high").applyInArrow(price, "lang string, a int, b int, value long")
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= most) if most else out


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK, sources: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: the distance of each group to every other source of its language, all ranks. Part ``term``: the terms
    more likely in the group than in its language, the ``top_terms`` first.
    """
    counts = stored(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n"), F.lit(1).alias("one"))
    kept = running_sum(kept.where(F.col("n_docs") >= least_docs), "lang", [F.col("term")], "one", "id").select("lang", "term", "lang_n", (F.col("id") - 1).alias("id"))
    kept = stored(kept, "kept-terms")
    used = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "id"), "used-terms")
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    numbers = Window.partitionBy("lang")
    groups = groups.select(
        "*", (F.row_number().over(numbers.orderBy("source")) - 1).alias("at"),
        (F.floor((F.count(F.lit(1)).over(numbers) - 1) / sources) + 1).cast("int").alias("parts"),
    )
    groups = stored(groups, "groups")

    values = stored(_pair_values(used, groups, block, sources), "pair-values")
    both = values.select("lang", F.col("a").alias("at"), F.col("b").alias("to"), "value").unionByName(
        values.select("lang", F.col("b").alias("at"), F.col("a").alias("to"), "value")
    )
    pairs = both.join(groups.select("lang", "at", "source"), ["lang", "at"]).join(
        groups.select("lang", F.col("at").alias("to"), F.col("source").alias("item")), ["lang", "to"]
    ).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = probability("n", "total", "terms"), probability("lang_n", "lang_total", "terms")
    terms = used.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    return _ranked(pairs).unionByName(_ranked(terms, top_terms))
