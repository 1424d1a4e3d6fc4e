"""N-gram Jaccard join: sets of word shingles that overlap by a given share link, and links form components.

A set's tokens stand in one global order, by fingerprint, and its prefix holds enough of them that linked sets share at
least ``slack`` prefix tokens. Index lists are skipped in three steps, none of which loses a link:

* sets: tokens that no other set has in its prefix are counted; a set with too many of them has no link and leaves
  before anything else of it moves;
* lists: of the rest, the rarest prefix tokens are indexed, in lists by token and size block; two entries of a list
  only meet where size and position leave room for the overlap;
* answers: equal sets are one set. Every set is first compared with the one it shares most lists with; sets linked so
  take over each other's answers. Only lists that are not connected by that are compared further, head by head, in
  blocks of sets.

Null and blank texts have no set, link with nothing and are their own component. Every row is a document: rows that share
an id but not the text, or have none, link by their own text. A component's name is its smallest id, null if it has none.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import mixed, numbered, rolling, slices, stored, text_bytes, word_hashes
from careerloom.llm.components import connected

#: Near-duplicate settings for stages that do not say otherwise.
NEAR = {"words": 5, "share": Fraction(80, 100)}
#: Prefix tokens that linked sets share at least, as a share of the set.
SLACK = Fraction(5, 100)
#: Sets of one head that a task compares with as many others.
BLOCK = 400

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets_of(flat: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text, ascending: (all in one array, bounds of each row)."""
    hashes, _, _, rows = word_hashes(_LOWER[flat], offsets)
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = rolling(hashes, words)
    inside = row[: len(whole)] == row[words - 1 :] if len(whole) else np.empty(0, bool)
    value, of = whole[inside], row[: len(whole)][inside]
    for n in range(1, words):  # shorter texts: all their words as one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.append(value, mixed(rolling(hashes, n)[rows[short]], 40 + n))
            of = np.append(of, short)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(value)]
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(len(counts) + 1))


def _least_overlap(n: np.ndarray, share: Fraction) -> np.ndarray:
    return -(-(n * share.numerator) // share.denominator)


def prefix_length(n: np.ndarray, share: Fraction) -> np.ndarray:
    """Tokens in the order that a set of ``n`` looks at."""
    return np.minimum(n, n - _least_overlap(n, share) + 1 + n * SLACK.numerator // SLACK.denominator)


def prefix_kept(n: np.ndarray, share: Fraction) -> np.ndarray:
    """Of the prefix, the rarest tokens that must be indexed: partners are at least ``share`` as large, and so is their slack."""
    partner = _least_overlap(n, share)
    return np.maximum(1, prefix_length(n, share) - np.maximum(partner * SLACK.numerator // SLACK.denominator, 1) + 1)


def shingle_sets(docs: DataFrame, words: int, share: Fraction, full: bool) -> DataFrame:
    """(doc_id, n, s1, s2, kept, tokens): size, fingerprint of the set, tokens to index and the prefix, or all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_bytes(batch.column(1))
            for a, b in slices(np.diff(offsets)):
                value, bounds = sets_of(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                n = np.diff(bounds)
                sums = [np.append(np.uint64(0), np.cumsum(mixed(value, seed)))[bounds] for seed in (3, 5)]
                sums = [(s[1:] - s[:-1]).view(np.int64) for s in sums]
                if not full:
                    take = prefix_length(n, share)
                    place = np.arange(len(value)) - np.repeat(bounds[:-1], n)
                    value = value[place < np.repeat(take, n)]
                    bounds = np.append(0, np.cumsum(take))
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(prefix_kept(n, share), pa.int64()), tokens],
                    ["doc_id", "n", "s1", "s2", "kept", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, kept long, tokens array<long>"
    )


def possible(sets: DataFrame) -> DataFrame:
    """Ids of the sets whose prefix holds few enough tokens of their own that they may have a link."""
    tokens = sets.select("doc_id", F.explode("tokens").alias("token"))
    own = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1")
    counted = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    narrow = sets.where("n > 0").select("doc_id", "kept")
    return narrow.join(counted, "doc_id", "left").where("coalesce(own, 0) < kept").select("doc_id").distinct()


def index_lists(sets: DataFrame, share: Fraction) -> DataFrame:
    """(token, block, id, n, at): the rarest prefix tokens of each set that another set has too, by block of sizes.

    Sizes that may link differ by one block at most; an entry stands in its own block and in the next.
    """
    length = F.least(F.col("n"), F.col("n") - F.col("least") + 1 + F.expr(f"n * {SLACK.numerator} div {SLACK.denominator}"))
    least = F.expr(f"(n * {share.numerator} + {share.denominator - 1}) div {share.denominator}")
    prefix = sets.withColumn("least", least).select("id", "n", "kept", length.alias("length"), F.posexplode(F.slice("tokens", F.lit(1), length)).alias("at", "token"))
    often = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = prefix.join(often, "token")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("times", "token")))
    ranked = ranked.withColumn("own", F.col("length") - F.count(F.lit(1)).over(Window.partitionBy("id")))
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(float(share)) + 1e-9)))
    return ranked.where("rank + own <= kept").select("token", F.explode(F.array(block, block + 1)).alias("block"), "id", "n", "at")


def _room(share: Fraction) -> str:
    """Whether the overlap may be large enough, from sizes and positions of a common token; x and y are entries."""
    need = f"{share.numerator} * (x_n + y_n) <= {share.numerator + share.denominator} * "
    return need + "(least(x_at, y_at) + 1 + least(x_n - x_at, y_n - y_at) - 1)"


def _named(lists: DataFrame, side: str) -> DataFrame:
    return lists.select("token", "block", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "at")])


def verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets do link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    joined = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return joined.where(share.denominator * common >= share.numerator * (F.size("x") + F.size("y") - common)).select("a", "b")


def linked_in_block(sizes: np.ndarray, tokens: np.ndarray, share: Fraction) -> np.ndarray:
    """Matrix of the links between the sets of a block. ``tokens`` holds all sets in turn."""
    known, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    several = np.flatnonzero(times > 1)
    place = np.full(len(known), -1)
    place[several] = np.arange(len(several))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    for start in range(0, len(several), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(sizes), min(4096, len(several) - start)), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    return share.denominator * common >= share.numerator * (sizes[:, None] + sizes[None, :] - common)


def links_of_block(ids: np.ndarray, parts: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of different parts, one for each two parts that have any."""
    i, j = np.nonzero(linked & (parts[:, None] < parts[None, :]))
    _, one = np.unique(np.stack([parts[i], parts[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.empty(0, int))
    return ids[i[one]], ids[j[one]]


def blocks_compared(members: DataFrame, sets: DataFrame, share: Fraction, names: list[str], answer: Callable) -> DataFrame:
    """``answer`` of every two blocks of a head; ``members``: (*head, id, and longs that ``answer`` reads), heads of two longs.

    A head's sets are dealt into blocks of about BLOCK sets, and every two blocks are compared in a task of their own: a
    task holds two blocks however many sets a head has. Pairs are matrix entries, never rows. ``answer`` takes the columns
    of the two blocks, with their numbers ``lo`` and ``hi`` and ``own``, the block of each set, and the matrix of links; it gives the two columns ``names``.
    """
    head = members.columns[:2]
    counted = members.groupBy(*head).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(counted, head).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*head, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *members.columns[2:], "own")
    full = dealt.join(sets.select("id", "tokens").hint("merge"), "id").select(*dealt.columns, "tokens")
    by = [*head, "lo", "hi"]
    ordered = full.repartition(*by).sortWithinPartitions(*by)
    read = dealt.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in [*batches, None]:
            new = [] if batch is None else [batch]
            rows = pa.Table.from_batches([*(rest or []), *new]) if rest or new else None
            if rows is None:
                return
            rows = rows.combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in by], axis=1)
            begins = np.flatnonzero(np.append(True, (np.diff(keys, axis=0) != 0).any(axis=1))[: len(keys)])
            ends = np.append(begins[1:], len(keys))
            if batch is not None and len(begins):
                begins, ends, cut = begins[:-1], ends[:-1], int(begins[-1])
            else:
                cut = len(keys)
            for start, stop in zip(begins.tolist(), ends.tolist()):
                part = rows.slice(start, stop - start).combine_chunks()
                listed = pa.concat_arrays(part.column("tokens").chunks)
                linked = linked_in_block(listed.value_lengths().to_numpy().astype(np.int64), listed.flatten().to_numpy(), share)
                two = answer({c: part.column(c).to_numpy() for c in read}, linked)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in two], names)
            rest = rows.slice(cut).to_batches()

    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def links_across(members: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Links (a, b) between sets of one head that are in different parts; ``members``: (head, id, part)."""
    placed = members.select("head", F.lit(0).cast("long").alias("_"), "id", "part")
    return blocks_compared(placed, sets, share, ["a", "b"], lambda c, linked: links_of_block(c["id"], c["part"], linked))


def linked_copies(columns: dict[str, np.ndarray], linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, documents of other sets that it links with) for the links that these two blocks are the ones to count.

    Two blocks count the links from one to the other; a block with itself those inside. Links among sets that only visit
    from the smaller sizes are counted where they are at home.
    """
    own, home, copies = columns["own"], columns["home"] == 1, columns["copies"]
    across = own[:, None] != own[None, :] if columns["lo"][0] < columns["hi"][0] else ~np.eye(len(own), dtype=bool)
    times = (linked & across & (home[:, None] | home[None, :])) @ copies
    some = np.flatnonzero(times)
    return columns["id"][some], times[some]


def link_counts(parts: DataFrame, classes: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """(id, links): documents of other sets that each set of ``parts`` (id, component) links with; ``classes``: (id, n, copies).

    Linked sets have one component and sizes at most a block of sizes apart; a set is compared at home and in the next one.
    """
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(float(share)) + 1e-9)))
    sized = parts.join(classes.select("id", "n", "copies"), "id").withColumn("size", block)
    both = F.explode(F.array(*[F.struct((F.col("size") + 1 - home).alias("size"), F.lit(home).cast("long").alias("home")) for home in (1, 0)]))
    members = sized.select("component", "id", "copies", both.alias("at")).select("component", "at.size", "id", "copies", "at.home")
    met = members.groupBy("component", "size").agg(F.max("home").alias("any"), F.count(F.lit(1)).alias("sets")).where("any = 1 and sets > 1")
    members = stored(members.join(met.select("component", "size"), ["component", "size"], "left_semi"), "sized-members")
    return blocks_compared(members, sets, share, ["id", "links"], linked_copies).groupBy("id").agg(F.sum("links").alias("links"))


def links(sets: DataFrame, share: Fraction) -> DataFrame:
    """Links (a, b) among ``sets`` (id, n, kept, tokens), as many as give all components."""
    lists = stored(index_lists(sets, share), "lists")
    heads = stored(lists.groupBy("token", "block").agg(F.min("id").alias("head")), "heads")
    head_rows = lists.join(heads.withColumnRenamed("head", "id"), ["token", "block", "id"], "left_semi")
    star = _named(lists, "y").join(_named(head_rows, "x"), ["token", "block"]).where("x_id < y_id").where(_room(share))
    star = star.groupBy(F.col("x_id").alias("a"), F.col("y_id").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    best = stored(star.groupBy("b").agg(F.max_by("a", F.struct("lists", -F.col("a"))).alias("a")).select("a", "b"), "best")
    found = stored(verified(best, sets, share), "links")
    # lists that the first answers leave in more than one part; their sets are compared under the list's head
    part = stored(connected(found), "parts")
    placed = lists.join(part, "id", "left").select("token", "block", "id", F.coalesce("component", "id").alias("part"))
    several = placed.groupBy("token", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token", "block")
    headed = heads.join(several, ["token", "block"], "left_semi")
    members = stored(placed.join(headed, ["token", "block"]).select("head", "id", "part").distinct(), "members")
    return found.unionByName(stored(links_across(members, sets, share), "links"))


def components(docs: DataFrame, words: int = 4, share: Fraction = Fraction(85, 100), counted: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``counted`` adds n_links, the number of other rows that the row links with, rows of equal sets included.
    """
    sets = stored(shingle_sets(docs, words, share, full=False), "sets")
    if not names_texts(sets):
        return components_of_rows(docs, words, share, counted)
    chosen = stored(possible(sets), "possible")
    texts = docs.select("doc_id", "text").join(chosen.hint("merge"), "doc_id", "left_semi")
    kept = stored(shingle_sets(texts, words, share, full=True), "full-sets")
    classes = stored(kept.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    first = kept.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id")
    first = first.agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("tokens").alias("tokens")).withColumnRenamed("doc_id", "id")
    first = stored(first, "class-sets")
    parts = connected(links(first, share))
    placed = classes.join(parts, "id", "left").withColumn("_component", F.coalesce("component", "id"))
    if counted:
        placed = placed.join(link_counts(parts, classes, first, share), "id", "left")
        placed = placed.withColumn("_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    facts = ["_component", *(["_links"] if counted else [])]
    member = kept.select("doc_id", "n", "s1", "s2").join(placed.select("n", "s1", "s2", *facts), ["n", "s1", "s2"])
    member = member.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in facts])
    out = sets.select("doc_id", "n").join(member, "doc_id", "left")
    more = [F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"), *more)


def names_texts(sets: DataFrame) -> bool:
    """Whether every row has an id and rows that share one have equal sets."""
    same = sets.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n", "s1", "s2")])
    return same.where("doc_id is null or min_n <> max_n or min_s1 <> max_s1 or min_s2 <> max_s2").isEmpty()


def components_of_rows(docs: DataFrame, words: int, share: Fraction, counted: bool = False) -> DataFrame:
    """``components`` where ids do not name texts: rows are numbered, and their ids come in at the end."""
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    found = components(rows.select(F.col("_row").alias("doc_id"), "text"), words, share, counted)
    found = found.withColumnsRenamed({"doc_id": "_row", "component_id": "_part"})
    placed = stored(rows.select("_row", "doc_id").join(found, "_row"), "placed")
    least = placed.groupBy("_part").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "_part").select("doc_id", "n_shingles", "component_id", *(["n_links"] if counted else []))
