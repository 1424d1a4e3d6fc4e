"""Mixing sources to target weights: random keys, a range sort, distributed prefix sums and an exact cut.

Null and unknown cases: a null text has size 0 and takes nothing; null sources form one source, the last; repeated rows
are separate rows of one source; a table without words has targets of 0; an empty table gives an empty result. Other
columns are kept as they are, also such as ``size`` or ``taken`` (the operator works on columns of its own names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.llm.common import numbered, stored, words_text

#: Weights dealt to the sources in order, over and over.
WEIGHTS = (5, 2, 1)
#: Words wanted, as a share of all words.
SHARE = 1.5
#: A source gives at most so many times its own size.
MOST_EPOCHS = 2


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``group`` up to each row, in ``order``.

    The rows are range-sorted by group and order, so a group of any size spreads over many partitions. Each partition
    sums its own rows; the partition totals (one row per group and partition) give the offsets. The sorted rows are
    stored, as the bounds of a range sort may differ when it is run again.
    """
    keys = [F.col(group).asc_nulls_last(), *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    local = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_group"), F.col("_part").alias("_from"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
    )
    summed = ranged.withColumn("_local", F.sum(value).over(local))
    joined = summed.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_from")))
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_group", "_from", "_part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Words that each source owes, from (source, source_size): source, source_size, weight, target.

    A source whose share exceeds ``most`` times its size stops there and the excess is shared anew among the others.
    That ends at one level: with sources in order of size over weight, the first ones are full and the rest get
    level times weight. Prefix sums of the ordered table find the level, so no round of sharing is simulated.
    """
    one = F.lit(1).alias("_one")
    ranked = running_sum(sizes.select("source", "source_size", one, F.lit(0).alias("_all")), "_all", [F.col("source").asc_nulls_last()], "_one", "_rank")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", choice.cast("double").alias("weight"), F.lit(0).alias("_all"), "_rank")
    weighed = weighed.withColumn("_full", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_full") / F.col("weight"))
    order = [F.col("_ratio"), F.col("_rank")]
    summed = running_sum(running_sum(weighed, "_all", order, "_full", "_full_sum"), "_all", order, "weight", "_weight_sum")
    whole = weighed.agg((F.sum("source_size") * F.lit(share)).alias("_want"), F.sum("weight").alias("_weights"))
    # if the sources before this one are full, the level of the rest; the sources are full while their ratio is below it
    tested = summed.join(F.broadcast(whole)).withColumn(
        "_level", (F.col("_want") - (F.col("_full_sum") - F.col("_full"))) / (F.col("_weights") - (F.col("_weight_sum") - F.col("weight")))
    )
    level = tested.where(F.col("_ratio") > F.col("_level")).agg(F.max("_level").alias("_final"))
    target = F.when(F.col("_final").isNull(), F.col("_full")).otherwise(F.least(F.col("_full"), F.col("_final") * F.col("weight")))
    return weighed.join(F.broadcast(level)).select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_EPOCHS, seed: int = 20, also: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source), and its columns ``also``.

    Whole epochs take every document; the last one takes documents in the order of a keyed hash until the source's
    target is met, and cuts inside the document that crosses it. Reruns and other partitionings give the same mix:
    the order depends on ids, sizes and, where rows share both, digests of the texts.
    """
    digest = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select("doc_id", "source", (words_text() if size is None else size).alias("size"), digest.alias("_digest"), *also)
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    placed = stored(running_sum(rows, "source", ["_key", "doc_id", "size", "_digest"], "size", "_sum"), "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    owed = stored(targets(sizes, weights, share, most), "targets")
    owed = owed.select(F.col("source").alias("_source"), "source_size", "target")
    joined = placed.join(owed, F.col("source").eqNullSafe(F.col("_source")))
    want = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0))
    rest = want - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_sum") - F.col("size"))))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + partial).cast("long").alias("taken"), *also
    )


def mixed_documents(docs: DataFrame, from_files: bool = False, **options) -> DataFrame:
    """The mix itself: a row for each whole copy taken, and one with the leading words where the cut fell.

    Columns stay those of ``docs``; rows of which nothing is taken go. A document cut in the first epoch keeps only
    the words before the cut, joined by single blanks. ``n_chars``, where there is one, follows the text.
    """
    rows = numbered(docs, from_files)
    taken = mix(rows, also=("_row",), **options).select("_row", F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    joined = rows.join(taken, "_row")
    part = F.pmod(F.col("_taken"), F.col("_size"))
    copies = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0)), F.lit(1), part.cast("int")), " ")
    pieces = F.concat(F.array_repeat(F.col("text"), copies), F.when(part > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    out = joined.where("_taken > 0").withColumn("text", F.explode(pieces))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
