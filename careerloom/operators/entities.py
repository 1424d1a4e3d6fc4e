"""Company names against an external entity list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import normalised_name, strip
from careerloom.operators.relational import enrich, first_k, flag_in_keys, keep_first, require_unique, with_share


def entity_lookup(entities: DataFrame) -> DataFrame:
    """One entity per normalised name: the first by name."""
    named = entities.select(
        normalised_name("entity_name").alias("company_name_norm"), F.col("entity_name").alias("entity_name_matched")
    )
    return keep_first(named.where(F.col("company_name_norm").isNotNull()), "company_name_norm")


def match_normalised_names(exp: DataFrame, entities: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Left join on the normalised name; the lookup side must be unique."""
    named = exp.withColumn("company_name_norm", normalised_name("company_name"))
    dim = require_unique(lookup if lookup is not None else entity_lookup(entities), "company_name_norm")
    return enrich(named, dim, "company_name_norm")


def match_rate(matched: DataFrame) -> DataFrame:
    """Rows, matched rows and their share."""
    hit = F.col("entity_name_matched").isNotNull()
    return matched.agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("n_matched"), F.avg(hit.cast("int")).alias("match_rate")
    )


def ambiguous_keys(entities: DataFrame, examples: int = 10) -> DataFrame:
    """Normalised names shared by several entities, with up to ten of them.

    The names are counted by a two-step aggregate and only the first ten per
    key are gathered.
    """
    pairs = entities.select(normalised_name("entity_name").alias("entity_name_norm"), "entity_name").where(
        F.col("entity_name_norm").isNotNull() & F.col("entity_name").isNotNull()
    ).distinct()
    counts = pairs.groupBy("entity_name_norm").agg(F.count("*").alias("n_names")).where("n_names > 1")
    shown = first_k(pairs, "entity_name_norm", examples).groupBy("entity_name_norm").agg(
        F.array_sort(F.collect_list("entity_name")).alias("name_examples")
    )
    return counts.join(shown, "entity_name_norm")


def match_types(matched: DataFrame, entities: DataFrame) -> DataFrame:
    """``matched``, ``ambiguous_norm_key`` and the exclusive ``match_type`` of each row."""
    keys = ambiguous_keys(entities).select(F.col("entity_name_norm").alias("company_name_norm"))
    hit = F.col("entity_name_matched").isNotNull()
    same = F.lower(strip("company_name")) == F.lower(strip("entity_name_matched"))
    exact, ruled, empty, other = fx.MATCH_TYPES
    kind = (
        F.when(hit & same, exact)
        .when(hit, ruled)
        .when(F.col("company_name_norm").isNull(), empty)
        .otherwise(other)
    )
    out = matched.withColumns({"matched": hit, "match_type": kind})
    return flag_in_keys(out, keys, "company_name_norm", "ambiguous_norm_key")


def match_type_counts(typed: DataFrame) -> DataFrame:
    """Rows and share per match type."""
    counts = typed.groupBy("match_type").agg(F.count("*").alias("n_rows"))
    return with_share(counts, "n_rows")


def match_type_examples(typed: DataFrame, k: int = 10) -> DataFrame:
    """First k rows of each match type."""
    cols = ["match_type", "company_name", "company_name_norm", "entity_name_matched", "ambiguous_norm_key"]
    return first_k(typed.select(*cols, "id"), "match_type", k, ["id"])


def ambiguous_uses(typed: DataFrame) -> DataFrame:
    """Experience rows under an ambiguous name: what the report counts and the examples are taken from, to be stored once."""
    rows = typed.where(F.col("ambiguous_norm_key"))
    return rows.select("company_name_norm", "company_name", "entity_name_matched", "ambiguous_norm_key", "id")


def ambiguous_key_report(entities: DataFrame, typed: DataFrame) -> DataFrame:
    """Ambiguous names with the number of experience rows that use them, most used first."""
    used = (
        typed.where(F.col("ambiguous_norm_key"))
        .groupBy(F.col("company_name_norm").alias("entity_name_norm"))
        .agg(F.count("*").alias("experience_rows"))
    )
    report = ambiguous_keys(entities).join(used, "entity_name_norm", "left")
    return report.withColumn("experience_rows", F.coalesce(F.col("experience_rows"), F.lit(0))).orderBy(
        F.desc("experience_rows"), F.desc("n_names"), "entity_name_norm"
    )


def ambiguous_row_examples(report: DataFrame, typed: DataFrame, keys: int = 5, k: int = 10) -> DataFrame:
    """First k experience rows of the most used ambiguous names."""
    top = report.orderBy(F.desc("experience_rows"), F.desc("n_names"), "entity_name_norm").limit(keys)
    chosen = typed.join(
        F.broadcast(top.select(F.col("entity_name_norm").alias("company_name_norm"))), "company_name_norm", "left_semi"
    )
    return first_k(chosen.select("company_name_norm", "company_name", "entity_name_matched", "id"), "company_name_norm", k, ["id"])
