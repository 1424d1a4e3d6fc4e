"""Education records, degrees and majors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import has, has_any, sorted_parts, starts, strip, whole_year
from careerloom.operators.relational import keep_first, share


def with_years(edu: DataFrame) -> DataFrame:
    """``year_from`` and ``year_to`` from the date texts."""
    return edu.withColumns({"year_from": whole_year("date_from"), "year_to": whole_year("date_to")})


def filter_graduation_years(
    edu: DataFrame, start: int = fx.GRADUATION_YEARS[0], end: int = fx.GRADUATION_YEARS[1], mode: str = "end"
) -> DataFrame:
    """Both years known and the end year in range (C5); mode ``either`` accepts the start year too."""
    dated = with_years(edu).na.drop(subset=["year_from", "year_to"])
    in_range = F.col("year_to").between(start, end)
    if mode == "either":
        in_range = in_range | F.col("year_from").between(start, end)
    elif mode != "end":
        raise ValueError("mode is 'end' or 'either'")
    return dated.where(in_range)


def clean_education(edu: DataFrame, generic_suffix: str = fx.GENERIC_SCHOOL_URL_SUFFIX) -> DataFrame:
    """Bachelor and master records, one per id, without online schools and generic URLs.

    The first row of an id is chosen before the URL and degree rules, so an id
    whose first row fails them is gone even if a later row would pass.
    """
    one_per_id = keep_first(edu.where(~has("title", fx.ONLINE_SCHOOLS)), "id")
    degree = F.col("subtitle")
    return one_per_id.where(
        ~F.coalesce(F.col("school_url").endswith(generic_suffix), F.lit(False))
        & degree.isNotNull()
        & has_any(degree, [fx.BACHELOR_DEGREE, fx.MASTER_DEGREE], ignore_case=False)
        & ~has_any(degree, fx.OTHER_DEGREES, ignore_case=False)
    )


def bachelors_flag(df: DataFrame, raw: str = "university_major_raw") -> DataFrame:
    """Start-anchored degree patterns on the lower-cased raw major."""
    return df.withColumn("bachelors_degree", starts(F.lower(raw), fx.BACHELOR_STARTS, ignore_case=False))


def clean_major(df: DataFrame, raw: str = "university_major_raw") -> DataFrame:
    """Raw major without degree prefixes and "minor ..." tails; bare short notes are dropped.

    The text may be a whole document: a pattern runs only where a plain test
    of the text leaves it a chance.
    """
    prefixed = F.lower(F.substring(raw, 1, 1)).eqNullSafe("b") | F.lower(raw).contains("master")
    text = strip(F.when(prefixed, F.regexp_replace(raw, "(?i)" + "|".join(fx.DEGREE_PREFIXES), "")).otherwise(F.col(raw)))
    text = strip(F.when(text.contains("inor"), F.regexp_replace(text, fx.MINOR_TAIL, "")).otherwise(text))
    out = df.withColumn("university_major_clean", text)
    return out.where(~(F.coalesce(text.startswith("("), F.lit(False)) & has("university_major_clean", fx.SHORT_NOTE, ignore_case=False)))


def _said(lowered: Column, words: list[str]) -> Column:
    """Whether the text contains a word of the list; a word that contains another one of it cannot matter."""
    short = [w for w in words if not any(v != w and v in w for v in words)]
    return reduce(or_, [lowered.contains(w) for w in short])


def major_category(lowered: Column | str) -> Column:
    """First category with a keyword in the lower-cased text, in list order."""
    text = F.col(lowered) if isinstance(lowered, str) else lowered
    branch = F
    for label, _, words in fx.MAJORS:
        branch = branch.when(_said(text, words), F.lit(label))
    return branch.otherwise(F.lit(fx.OTHER_MAJOR[0]))


def major_columns() -> list[str]:
    return [f"major_{name}" for _, name, _ in fx.MAJORS] + [f"major_{fx.OTHER_MAJOR[1]}"]


def categorise_major(df: DataFrame) -> DataFrame:
    """Category text and one 0/1 column per category."""
    out = df.withColumn("_lowered", F.lower("university_major_clean"))
    out = out.withColumn("university_major_categorized", sorted_parts(major_category("_lowered"))).drop("_lowered")
    label = F.col("university_major_categorized")
    named = [(text, name) for text, name, _ in fx.MAJORS] + [fx.OTHER_MAJOR]
    return out.withColumns({f"major_{name}": (label == text).cast("int") for text, name in named})


def major_summary(df: DataFrame) -> DataFrame:
    """Count and percent per category column (C29): one aggregate, then unpivoted."""
    cols = major_columns()
    totals = df.agg(F.count("*").alias("_all"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    return totals.unpivot("_all", cols, "category", "n").select(
        "category", "n", (share(F.col("n"), F.col("_all")) * 100).alias("pct")
    )


def graduates_by_year(edu: DataFrame, start: int = 1994, end: int = 2011) -> DataFrame:
    """Entries per graduation and per start year (C54, A19): one aggregate over both kinds."""
    return (
        edu.select("year_to", "year_from")
        .unpivot([], ["year_to", "year_from"], "kind", "year")
        .where(F.col("year").between(start, end))
        .groupBy("kind", "year")
        .agg(F.count("*").alias("n"))
    )


def top_institutions(edu: DataFrame, k: int = 50) -> DataFrame:
    """Institutions with the most entries (C54, T2); the limit is the report."""
    counts = edu.where(F.col("instnm").isNotNull()).groupBy("instnm").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "instnm").limit(k)


def institution_by_year(edu: DataFrame, institution: str) -> DataFrame:
    """Entries of one institution per graduation year."""
    return (
        edu.where((F.col("instnm") == institution) & F.col("year_to").isNotNull())
        .groupBy("year_to")
        .agg(F.count("*").alias("n"))
    )
