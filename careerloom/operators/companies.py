"""Company URLs, founding years and scores on experience rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.ranks import exact_percentiles
from careerloom.functions.text import canonical_url, strip, to_number
from careerloom.operators.relational import enrich


def shrink(exp: DataFrame) -> DataFrame:
    """Drop the bulky columns (C14)."""
    return exp.drop(*fx.BULKY_COLUMNS)


def merge_company_scores(exp: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Score columns by company name; stale ones are replaced, and no table means no change."""
    if scores is None:
        return exp
    fresh = [c for c in scores.columns if c != "company_name"]
    stale = [c for c in exp.columns if c in fx.SCORE_COLUMNS or c in fresh]
    return enrich(exp.drop(*stale), scores, "company_name")


def founding_years(companies: DataFrame, host: str = "linkedin.com") -> DataFrame:
    """Earliest numeric founding year per canonical URL."""
    return (
        companies.where(F.col("url").isNotNull())
        .groupBy(canonical_url("url", host).alias("company_url"))
        .agg(F.min(to_number("founded")).alias("company_page_founded_year"))
    )


def with_founded(exp: DataFrame, companies: DataFrame, host: str = "linkedin.com") -> DataFrame:
    """The year as the company page gives it, beside the URL as written: all that ``founding_year`` looks up."""
    years = founding_years(companies, host).withColumnRenamed("company_url", "_url")
    return enrich(exp.withColumn("_url", canonical_url("company_url", host)), years, "_url").drop("_url")


def founding_year(exp: DataFrame, companies: DataFrame | None, host: str = "linkedin.com") -> DataFrame:
    """Canonical company URL and its founding year, null outside 1900..2030."""
    if companies is None:
        return exp
    out = exp.withColumn("company_url", canonical_url("company_url", host))
    if "company_page_founded_year" not in out.columns:
        out = enrich(out, founding_years(companies, host), "company_url")
    year = F.col("company_page_founded_year")
    return out.withColumn("company_page_founded_year", F.when(year.between(*fx.FOUNDED_YEARS), year))


def founding_gaps(exp: DataFrame) -> DataFrame:
    """Founder and owner rows with ``year_diff`` = job start - founding year."""
    return exp.where(F.col("is_founder_or_owner")).withColumn(
        "year_diff", F.col("job_from") - F.col("company_page_founded_year")
    )


def founding_gap_summary(exp: DataFrame) -> DataFrame:
    """``metric, value``: count, mean, sd, min, max and nine exact percentiles of the gap."""
    gaps = founding_gaps(exp).where(F.col("year_diff").isNotNull()).select(
        F.lit("gap").alias("g"), F.col("year_diff").cast("double").alias("v")
    )
    stats = gaps.agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    flat = stats.unpivot([], ["count", "mean", "std", "min", "max"], "metric", "value")
    cut = exact_percentiles(gaps, "g", "v", fx.GAP_PERCENTILES)
    return flat.unionByName(cut.select(F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int")).alias("metric"), "value"))


def founding_gap_signs(exp: DataFrame) -> DataFrame:
    """Counts and shares of gaps below, at and above zero."""
    v = F.col("year_diff")
    one = founding_gaps(exp).where(v.isNotNull()).agg(
        F.count("*").alias("all"),
        F.count_if(v < 0).alias("before_founded"),
        F.count_if(v == 0).alias("same_year"),
        F.count_if(v > 0).alias("after_founded"),
    )
    return one.unpivot("all", ["before_founded", "same_year", "after_founded"], "direction", "n").select(
        "direction", "n", F.try_divide(F.col("n").cast("double"), F.col("all").cast("double")).alias("share")
    )


def founding_gap_extremes(exp: DataFrame, k: int = 10) -> DataFrame:
    """The k smallest and k largest gaps (T3); the limits are the report."""
    cols = ["id", "member_id", "title", "company_name", "job_from", "company_page_founded_year", "year_diff"]
    gaps = founding_gaps(exp).where(F.col("year_diff").isNotNull()).select(*cols)
    low = gaps.orderBy("year_diff", *cols).limit(k).withColumn("side", F.lit("smallest"))
    high = gaps.orderBy(F.desc("year_diff"), *cols).limit(k).withColumn("side", F.lit("largest"))
    return low.unionByName(high)


def url_duplicate_count(companies: DataFrame) -> DataFrame:
    """Rows beyond the first of each non-empty URL (C53), as one aggregate."""
    url = strip("url")
    per_url = companies.where(url != "").groupBy(url.alias("u")).agg(F.count("*").alias("n"))
    return per_url.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_urls"))
