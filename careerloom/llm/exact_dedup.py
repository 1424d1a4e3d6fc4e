"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text, without its blanks, is cut into chunks where its own characters say so, and its recipe is the ordered list of
chunk names. Documents are compared by their recipes, so no text moves, however long it is. The names are verified:
over all documents whose recipe occurs twice, a name must always go with one SHA-256 digest of the chunk. Documents
with a name that does not compare by the digest of the whole text as well.

Null text counts as empty; empty and blank texts are equal to each other. Repeated rows are separate rows with the same
id; one of them stays. Null ids come after all others. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import stored

#: A chunk ends after one of these letter pairs, but not before MIN_CHUNK characters and at latest after MAX_CHUNK.
CUT_AFTER = "(?:[aeiou][tnr][,.;:]|[\\u3000-\\u9fff][\\u3001\\u3002])"
MIN_CHUNK, MAX_CHUNK = 256, 8192
BLANKS = " \n\t\r\v\f"


def normalised(text: str = "text") -> Column:
    """The text without the six ASCII blanks; null is empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def chunks(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """Array of the consecutive chunks of a text."""
    pattern = f"(?s).{{{smallest},{largest}}}?{CUT_AFTER}|(?s).{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text_sha256, recipe) per row; recipe: (length, name, digest) of each chunk, in order."""
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised().alias("_norm"))
    named = F.transform(
        chunks(F.col("_norm")),
        lambda c: F.struct(F.octet_length(c).alias("n"), F.xxhash64(c).alias("name"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest")),
    )
    return norm.select("doc_id", "n_chars", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"), named.alias("recipe"))


def unverified_names(candidates: DataFrame) -> DataFrame:
    """Chunk names (n, name) that go with more than one digest."""
    pieces = candidates.select(F.inline("recipe"))
    digests = pieces.groupBy("n", "name").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return digests.where("lo <> hi").select("n", "name")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    Of equal texts the one with the most characters before blanks were deleted stays, then the smallest id, then the
    first of the stored recipes, whose rows carry a number of their own.
    """
    made = recipes(docs).withColumn("row", F.monotonically_increasing_id())
    names = F.transform("recipe", lambda c: F.concat_ws(":", c["n"].cast("string"), c["name"].cast("string")))
    made = stored(made.withColumn("recipe_key", F.sha2(F.array_join(names, " ").cast("binary"), 256)), "recipes")
    repeated = made.groupBy("recipe_key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select("recipe_key")
    candidates = stored(made.join(repeated, "recipe_key", "left_semi"), "candidates")
    clashes = stored(unverified_names(candidates), "clashes")
    marked = (
        candidates.select("recipe_key", F.explode("recipe").alias("c")).select("recipe_key", F.col("c.n").alias("n"), F.col("c.name").alias("name"))
        .join(clashes, ["n", "name"], "left_semi").select("recipe_key").distinct().withColumn("clash", F.lit(True))
    )
    keyed = candidates.join(marked, "recipe_key", "left").select(
        "doc_id", "row", "n_chars", "text_sha256", F.concat("recipe_key", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).alias("class")
    )
    best = keyed.groupBy("class").agg(
        F.max("n_chars").alias("best_chars"), F.count(F.lit(1)).alias("group_size")
    )
    with_best = keyed.join(best, "class")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = with_best.where("n_chars = best_chars").groupBy("class").agg(F.min(order).alias("first"))
    groups = with_best.join(first, "class").select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    alone = made.join(repeated, "recipe_key", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(groups)
