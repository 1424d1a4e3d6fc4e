"""Ownership aggregates over companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import has, starts
from careerloom.operators.relational import (
    Skew,
    broadcast_by_size,
    enrich,
    flag_in_keys,
    in_keys,
    keep_columns,
    measure_skew,
    not_in,
    not_in_keys,
    share,
)
from careerloom.operators.titles import broad_founder_flag, event_names
from careerloom.session import stored


def company_ownership(exp: DataFrame, drop_self_names: bool = False) -> DataFrame:
    """Distinct founders, owners and either per company name, placeholder names left out.

    The rows are first reduced to one per (company, member), so a company of
    any size is counted in parallel and the three counts need no row copies.
    """
    people = (
        exp.where((F.col("is_founder_only") | F.col("is_owner_only")) & F.col("company_name").isNotNull())
        .where(not_in("company_name", fx.PLACEHOLDER_NAMES_EXACT) & ~has("company_name", fx.PLACEHOLDER_NAME))
        .groupBy("company_name", "member_id")
        .agg(
            F.max("is_founder_only").alias("f"),
            F.max("is_owner_only").alias("o"),
        )
    )
    if drop_self_names:
        people = people.where(~starts("company_name", ["'?self"]))
    known = F.col("member_id").isNotNull()
    out = people.groupBy("company_name").agg(
        F.count_if(known & F.col("f")).alias("num_unique_founders"),
        F.count_if(known & F.col("o")).alias("num_unique_owners"),
        F.count_if(known).alias("num_unique_founders_or_owners"),
    )
    return out.withColumn(
        "share_founders_vs_owners", share(F.col("num_unique_founders"), F.col("num_unique_founders_or_owners"))
    )


def franchises(ownership: DataFrame) -> DataFrame:
    """Companies with many owners and few founders."""
    ratio = F.col("share_founders_vs_owners")
    return ownership.where(
        ~F.coalesce(ratio > fx.FOUNDER_RUN_SHARE, F.lit(False))
        & (F.col("num_unique_founders_or_owners") > fx.FRANCHISE_MIN_PEOPLE)
        & (ratio < fx.FRANCHISE_MAX_FOUNDER_SHARE)
    )


def franchise_flags(exp: DataFrame, drop_self_names: bool = False) -> DataFrame:
    """Flag founders and owners of franchise-like companies.

    Only founder and owner rows can be flagged, so the lookup key of all other
    rows is blank: they are spread evenly instead of following their company.
    """
    found = stored(franchises(company_ownership(exp, drop_self_names)).select(F.col("company_name").alias("_key")), "franchises")
    key = F.when(F.col("is_founder_only") | F.col("is_owner_only"), F.col("company_name"))
    out = flag_in_keys(
        exp.withColumn("_key", key),
        found,
        "_key",
        "_franchise",
        Skew() if broadcast_by_size(found) else measure_skew(exp, "company_name", nulls=True),
    )
    return out.withColumns({
        "franchise_founder_or_owner": F.col("_franchise") & F.col("is_founder_or_owner"),
        "franchise_owner": F.col("_franchise") & F.col("is_owner_only"),
    }).drop("_key", "_franchise")


def cofounder_urls(exp: DataFrame) -> DataFrame:
    """URLs whose founder and owner flags add up to 2..10.  Flags are counted, not people."""
    return (
        exp.where(F.col("is_founder_or_owner") & F.col("company_url").isNotNull())
        .groupBy("company_url")
        .agg(
            F.count_if("is_founder_only").alias("founders"),
            F.count_if("is_owner_only").alias("owners"),
        )
        .where((F.col("founders") + F.col("owners")).between(*fx.COFOUNDER_RANGE))
    )


def cofounder_flags(exp: DataFrame) -> DataFrame:
    """Founder or owner rows at a URL shared by 2..10 of them."""
    urls = stored(cofounder_urls(exp).select(F.col("company_url").alias("_key")), "cofounder-urls")
    key = F.when(F.col("is_founder_or_owner"), F.col("company_url"))
    out = flag_in_keys(
        exp.withColumn("_key", key),
        urls,
        "_key",
        "cofound_coown_same_url",
        Skew() if broadcast_by_size(urls) else measure_skew(exp, "company_url", nulls=True),
    )
    return out.drop("_key")


def employee_before_founder_filter(exp: DataFrame) -> DataFrame:
    """Void the founder flags of companies where someone worked before the first founder.

    The first years come from one map-side combined aggregate; a window would
    bring every row of a company into one task.  ``enrich`` stores
    them, so rows only move where that table is large.
    """
    out = broad_founder_flag(exp).withColumn(
        "founder_job_from", F.when(F.col("is_founder_or_owner"), F.col("job_from"))
    )
    starts_by_name = (
        out.where(F.col("company_name").isNotNull())
        .groupBy("company_name")
        .agg(
            F.min("job_from").alias("flt_company_employee_start_year"),
            F.min("founder_job_from").alias("flt_company_founder_start_year"),
        )
    )
    out = enrich(out, starts_by_name, "company_name")
    earlier = F.col("flt_company_employee_start_year") < F.col("flt_company_founder_start_year")
    out = out.withColumn("flt_employee_before_founder", F.coalesce(earlier, F.lit(False)))
    return out.withColumns({
        "flt_is_founder_or_owner": F.col("is_founder_or_owner") & ~F.col("flt_employee_before_founder"),
        "ih_flt_is_founder_or_owner": F.col("ih_is_founder_or_owner") & ~F.col("flt_employee_before_founder"),
    })


def _people_per(df: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Distinct members per key, reduced to one row per (key, member) first."""
    return df.where(F.col(key).isNotNull()).select(key, member).distinct().groupBy(key).agg(F.count(member).alias(name))


def cofounder_events(panel: DataFrame, flag: str = "is_founder_or_owner_5_years_o") -> DataFrame:
    """Founders within five years whose URL has 2..10 distinct members, as distinct events."""
    founders = stored(panel.where(F.col("company_url").isNotNull() & F.col(flag)), "founders")
    people = _people_per(founders, "company_url", "member_id", "number_of_founders")
    chosen = people.where(F.col("number_of_founders").between(*fx.COFOUNDER_RANGE))
    events = in_keys(founders, chosen, "company_url")
    return keep_columns(event_names(events), fx.EVENT_COLUMNS).distinct()


def with_people_at_url(founders: DataFrame) -> DataFrame:
    """Distinct members at the URL, and the first start year there, as columns of each row.

    Rows are reduced to one per (URL, member) first; both columns come from
    that one table, so the rows are looked up once.
    """
    per_member = founders.where(F.col("company_url").isNotNull()).groupBy("company_url", "member_id").agg(
        F.min("job_from").alias("job_from")
    )
    per_url = per_member.groupBy("company_url").agg(
        F.count("member_id").alias("unique_member_count"), F.min("job_from").alias("first_year_cofound")
    )
    return enrich(founders, per_url, "company_url", "inner")


def cofounder_events_strict(panel: DataFrame, parity: bool = False) -> DataFrame:
    """With-URL founders at URLs of 2..9 members, started within four years of the first.

    Names with more than ten distinct founders are dropped.  ``parity`` keeps
    the published slip of looking the names up in the URL column.
    """
    founders = with_people_at_url(stored(panel.where(F.col("is_founder_or_owner_with_url")), "founders"))
    events = founders.where(F.col("unique_member_count").between(*fx.STRICT_COFOUNDER_RANGE))
    repeated = _people_per(events, "company_name", "member_id", "people").where(
        F.col("people") > fx.REPETITIVE_NAME_FOUNDERS
    )
    near = events.where(F.col("job_from") <= F.col("first_year_cofound") + fx.STRICT_COFOUNDER_YEARS)
    kept = not_in_keys(near, repeated, "company_url" if parity else "company_name", "company_name")
    return event_names(kept)
