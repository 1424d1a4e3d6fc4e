"""Job-title rules: founders, owners, work roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import has, has_any, remove_in_order, says, strip, year_in
from careerloom.operators.relational import rename


def is_owner(title: Column | str) -> Column:
    """The word "owner", outside the titles that only sound like one.

    ``&`` evaluates left first, so the exclusion patterns run only on the rows
    that say owner at all.
    """
    return has(title, fx.OWNER) & ~has_any(title, fx.NOT_OWNER)


def _founder_excluded(title: Column | str) -> Column:
    """Weak founder title, unless a founder word is left once the weak phrases are cut out."""
    rest = remove_in_order(title, fx.WEAK_FOUNDER_PHRASES)
    return has_any(title, fx.NOT_FOUNDER) & ~has(rest, fx.STRONG_FOUNDER)


def is_founder(title: Column | str) -> Column:
    return has(title, fx.FOUNDER) & ~_founder_excluded(title)


def founder_owner_flags(exp: DataFrame, with_long_title: bool = False) -> DataFrame:
    """Founder, owner and co- flags, job start year, with-URL and incorporated-name flags (C11)."""
    founder, owner = F.col("is_founder_only"), F.col("is_owner_only")
    # "co-founder" contains "founder", and "co-owner" has its owner word set
    # off only by - or space; "coowner" is caught by the co- pattern alone.
    out = exp.withColumns({
        "job_from": year_in("date_from"),
        "is_founder_only": is_founder("title"),
        "is_owner_only": is_owner("title"),
        "is_coowner_only_title": has("title", fx.COOWNER) & ~has_any("title", fx.NOT_OWNER),
    })
    out = out.withColumns({
        "is_cofounder_only_title": founder & has("title", fx.COFOUNDER),
        "is_founder_or_owner": founder | owner,
    })
    out = out.withColumns({
        "is_cofounder_or_coowner_title": F.col("is_cofounder_only_title") | F.col("is_coowner_only_title"),
        "is_founder_or_owner_with_url": F.col("is_founder_or_owner") & F.col("company_url").isNotNull(),
        "is_founder_or_owner_inc": F.col("is_founder_or_owner") & has("company_name", fx.INCORPORATED_NAME),
    })
    if with_long_title:
        out = out.withColumn("long_title", F.coalesce(F.size(F.split(strip("title"), r"\s+")) >= 4, F.lit(False)))
    return out


def broad_founder_flag(exp: DataFrame, name: str = "ih_is_founder_or_owner") -> DataFrame:
    """Simple keyword rule: entrepreneur, founder, owner, with or without co- (C20).

    ``fx.BROAD_FOUNDER`` without its optional parts, which decide nothing.
    """
    return exp.withColumn(name, says("title", "entrepreneur", "founder", "owner"))


def work_role_flags(df: DataFrame, title: str = "title_experience") -> DataFrame:
    """Engineer and sales keywords in the job title."""
    return df.withColumns({"worked_as_engineer": says(title, "engineer"), "worked_in_sales": says(title, "sales")})


def founder_events_raw(exp: DataFrame) -> DataFrame:
    """Rows with a URL whose title contains founder or owner."""
    title = F.lower("title")
    return exp.where(F.col("company_url").isNotNull() & (title.contains("founder") | title.contains("owner")))


def filter_founder_titles(events: DataFrame, title: str = "title_experience") -> DataFrame:
    """Drop product, systems and process owners."""
    return events.where(~has(title, fx.NON_FOUNDER_OWNER_TITLES))


def select_entrepreneurs(exp: DataFrame) -> DataFrame:
    """Founder or owner rows, by the joint flag or else the two part flags."""
    if "is_founder_or_owner" in exp.columns:
        return exp.where(F.col("is_founder_or_owner"))
    if {"is_founder_only", "is_owner_only"} <= set(exp.columns):
        return exp.where(F.col("is_founder_only") | F.col("is_owner_only"))
    raise ValueError("no founder or owner flag among the columns")


def company_names(df: DataFrame) -> DataFrame:
    """Distinct non-blank company names, trimmed."""
    return df.select(strip("company_name").alias("company_name")).where("company_name <> ''").distinct()


def dated(exp: DataFrame) -> DataFrame:
    """Rows with a start date, the input rule of the flag step."""
    return exp.where(F.col("date_from").isNotNull())


def event_names(df: DataFrame) -> DataFrame:
    """Names of the event tables."""
    return rename(df, fx.EVENT_NAMES)
