"""Table profiles and definition comparisons.

Wide statistics are one aggregate, unpivoted afterwards.  Anything that needs
the values themselves works on counts per (column, value), so neither a column
nor a frequent value is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType, StringType

from careerloom.functions import fixed_values as fx
from careerloom.functions.ranks import exact_percentiles
from careerloom.operators.relational import any_differs, columns_like, keep_first, share


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def _unpivoted(one_row: DataFrame, per_column: Mapping[str, Sequence[str]], shared: Sequence[str] = ()) -> DataFrame:
    """Row of aggregates named ``<column>|<stat>`` to one row per column."""
    records = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats])
        for c, stats in per_column.items()
    ])
    return one_row.select(*shared, F.inline(records))


def long_values(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``column, value`` of the non-null values, cast to one type."""
    cast = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    return cast.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())


def overview(df: DataFrame) -> DataFrame:
    """``metric, value``: rows, columns and columns per type (Q1)."""
    kinds: dict[str, int] = {}
    for _, kind in df.dtypes:
        kinds[kind] = kinds.get(kind, 0) + 1
    facts = {"columns": len(df.columns), **{f"columns of type {k}": n for k, n in kinds.items()}}
    one = df.agg(F.count("*").alias("rows"), *[F.lit(n).cast("long").alias(k) for k, n in facts.items()])
    return one.unpivot([], ["rows", *facts], "metric", "value")


def missing_values(df: DataFrame, k: int | None = None) -> DataFrame:
    """Null count and percent per column (Q2); ``k`` limits the report to the worst columns."""
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    out = one.unpivot("_all", df.columns, "column", "n_missing").select(
        "column", "n_missing", (share(F.col("n_missing"), F.col("_all")) * 100).alias("pct_missing")
    )
    return out if k is None else out.orderBy(F.desc("pct_missing"), "column").limit(k)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per numeric column (Q3)."""
    cols = list(columns or numeric_columns(df))
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{s}") for c in cols for s, f in stats.items()])
    base = _unpivoted(one, {c: list(stats) for c in cols})
    cuts = exact_percentiles(long_values(df, cols, "double"), "column", "value", [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    quartiles = cuts.groupBy("column").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    return base.join(quartiles, "column", "left")


def numeric_extras(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Median, smallest mode, variance, bias-corrected skewness and excess kurtosis (Q4)."""
    cols = list(columns or numeric_columns(df))
    stats = {"n": F.count, "variance": F.var_samp, "g1": F.skewness, "g2": F.kurtosis}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{s}") for c in cols for s, f in stats.items()])
    n = F.col("n").cast("double")
    base = _unpivoted(one, {c: list(stats) for c in cols}).select(
        "column",
        "variance",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )
    values = long_values(df, cols, "double")
    median = exact_percentiles(values, "column", "value", [0.5]).select("column", F.col("value").alias("median"))
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    mode = keep_first(counts, "column", [F.desc("n"), F.asc("value")]).select("column", F.col("value").alias("mode"))
    return base.join(median, "column", "left").join(mode, "column", "left")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, the most frequent one (ties: the smallest), its count and percent of all rows (Q5)."""
    cols = list(columns or text_columns(df))
    counts = long_values(df, cols, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_unique"))
    top = keep_first(counts, "column", [F.desc("n"), F.asc("value")]).select(
        "column", F.col("value").alias("most_frequent"), F.col("n").alias("most_frequent_count")
    )
    rows = df.agg(F.count("*")).scalar()
    return distinct.join(top, "column").withColumn(
        "most_frequent_pct", share(F.col("most_frequent_count"), rows) * 100
    )


def binary_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """True and false counts of the columns with exactly two values, both from the known pairs (Q6)."""
    cols = list(columns or df.columns)
    # numbers count by value, so that 0.0 and 1.0 of a fractional column are 0 and 1
    real = [f.name for f in df.schema if f.name in cols and isinstance(f.dataType, NumericType) and not isinstance(f.dataType, IntegralType)]
    plain = df.withColumns({c: F.when(F.col(c) == 0, "0").when(F.col(c) == 1, "1").otherwise(F.col(c).cast("string")) for c in real})
    # a counter per listed value and one for the rest, so no value is shuffled, however long or many they are
    listed = plain.select(*[F.when(text.isin(*fx.BINARY_VALUES), text).when(text.isNotNull(), "").alias(c) for c in cols for text in [F.col(c).cast("string")]])
    counts = long_values(listed, cols, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    yes, other = F.col("value").isin(*fx.TRUE_VALUES), F.col("value") == ""
    rows = df.agg(F.count("*")).scalar()
    return (
        counts.groupBy("column")
        .agg(
            F.count_if(other).alias("_others"),
            F.count_if(~other).alias("_known"),
            F.coalesce(F.sum(F.when(yes, F.col("n"))), F.lit(0)).alias("n_true"),
            F.coalesce(F.sum(F.when(~yes, F.col("n"))), F.lit(0)).alias("n_false"),
        )
        .where("_others = 0 and _known = 2")
        .select("column", "n_true", "n_false", (share(F.col("n_true"), rows) * 100).alias("pct_true"))
    )


def row_quality(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``metric, value``: empty rows, mostly empty rows, completeness (Q8, Q10)."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    width = len(df.columns)
    one = df.select(nulls.alias("k")).agg(
        F.count_if(F.col("k") == width).cast("double").alias("empty_rows"),
        F.count_if(F.col("k") / width > threshold).cast("double").alias("mostly_empty_rows"),
        ((F.count("*") * width - F.sum("k")) * 100.0 / (F.count("*") * width)).alias("completeness_pct"),
    )
    return one.unpivot([], ["empty_rows", "mostly_empty_rows", "completeness_pct"], "metric", "value")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row, and their percent (Q7)."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
        (F.try_divide(F.sum(F.col("_n") - 1).cast("double"), F.sum("_n")) * 100).alias("pct_duplicates"),
    )


def id_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids and surplus rows (Q9)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(key).alias("n_ids"),
    ).withColumn("n_surplus", F.col("n_rows") - F.col("n_ids"))


def column_groups(df: DataFrame, groups: Mapping[str, Sequence[str]] = fx.COLUMN_GROUPS) -> dict[str, list[str]]:
    """Column names by keyword group (Q11)."""
    return {name: columns_like(df, parts) for name, parts in groups.items()}


def quality_metrics(edu: DataFrame, exp: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """``metric, value``: year range and members of education, rows and flag shares of experience."""
    members = edu.groupBy("member_id").agg(F.min("year_to").alias("lo"), F.max("year_to").alias("hi"), F.count("*").alias("n"))
    one = members.agg(
        F.sum("n").cast("double").alias("education_rows"),
        F.count("member_id").cast("double").alias("education_members"),
        F.min("lo").cast("double").alias("year_to_min"),
        F.max("hi").cast("double").alias("year_to_max"),
    )
    two = exp.agg(
        F.count("*").cast("double").alias("experience_rows"),
        F.count_if(F.col("company_name").isNull()).cast("double").alias("company_name_missing"),
        *[F.avg(F.col(c).cast("int")).alias(f"mean_{c}") for c in flags],
    )
    return one.unpivot([], one.columns, "metric", "value").unionByName(two.unpivot([], two.columns, "metric", "value"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values (Q12, T2); the limit is the report."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


# --- comparing definitions --------------------------------------------------

def flag_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, known rows, true rows and share true per flag."""
    one = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count(c).alias(f"{c}|n_known") for c in columns],
        *[F.count_if(F.col(c)).alias(f"{c}|n_true") for c in columns],
    )
    return _unpivoted(one, {c: ["n_known", "n_true"] for c in columns}, ["n_rows"]).withColumn(
        "share_true", share(F.col("n_true"), F.col("n_known"))
    )


def pairwise_disagreement(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on which each pair of flags differs."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    records = F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("n_differ")) for a, b in pairs
    ])
    return one.select(F.inline(records))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way counts with margins named All.

    The cube runs on the distinct pairs with their counts, not on the rows.
    """
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cube = counts.cube(a, b).agg(
        F.sum("n").alias("n"), F.grouping(a).alias("_all_a"), F.grouping(b).alias("_all_b")
    )
    return cube.select(
        F.when(F.col("_all_a") == 1, "All").otherwise(F.coalesce(F.col(a).cast("string"), F.lit("null"))).alias(a),
        F.when(F.col("_all_b") == 1, "All").otherwise(F.coalesce(F.col(b).cast("string"), F.lit("null"))).alias(b),
        "n",
    )


def differing_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on which some definition differs from the first."""
    return df.where(any_differs(columns))


# --- columns and labels -----------------------------------------------------

def label_coverage(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Every column and label with its status and, for columns, the known values."""
    cols = df.columns
    one = df.agg(*[F.count(c).alias(c) for c in cols])
    counted = one.unpivot([], cols, "column", "n_known")
    described = df.sparkSession.createDataFrame(list(labels.items()), "column string, label string")
    return counted.join(described, "column", "full").withColumn(
        "status",
        F.when(F.col("n_known").isNull(), "label without column")
        .when(F.col("label").isNull(), "column without label")
        .otherwise("labelled"),
    )


def binary_to_int(df: DataFrame) -> DataFrame:
    """Cast the columns holding only 0, 1 and null to whole numbers.

    One aggregate decides for all columns at once; its single row is the only
    thing the driver sees.
    """
    cols = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType))]
    if not cols:
        return df
    other = df.agg(*[F.count_if(~F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c).cast("long") for c in cols if other[c] == 0})
