"""Early-career finance shares by school and graduation year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finance_by_school_year(panel: DataFrame, years_after: int = 2) -> DataFrame:
    """Jobs, graduates, mean probabilities and estimated head counts per (unitid, year_to).

    Rows are reduced to one per graduate first, so a distinct count of
    graduates needs no second copy of the rows and a large school spreads.
    """
    early = panel.where(F.col("job_from") <= F.col("year_to") + years_after)
    probs = {"finance_broad": "prob_is_finance_broad", "wallstreet": "prob_is_wallstreet"}
    per_person = early.groupBy("unitid", "year_to", "member_id").agg(
        F.count("member_id").alias("jobs"),
        *[F.sum(c).alias(f"sum_{k}") for k, c in probs.items()],
        *[F.count(c).alias(f"n_{k}") for k, c in probs.items()],
    )
    cells = per_person.groupBy("unitid", "year_to").agg(
        F.sum("jobs").alias("n_jobs"),
        F.count("member_id").alias("n_graduates"),
        *[F.try_divide(F.sum(f"sum_{k}"), F.sum(f"n_{k}")).alias(f"avg_prob_{k}") for k in probs],
    )
    return cells.withColumns({f"est_count_{k}": F.col(f"avg_prob_{k}") * F.col("n_graduates") for k in probs})


#: What a cell knows about its school and year.
CELL_COLUMNS = (
    "n_jobs", "n_graduates", "avg_prob_finance_broad", "avg_prob_wallstreet", "est_count_finance_broad", "est_count_wallstreet",
)


def merge_finance(panel: DataFrame, cells: DataFrame) -> DataFrame:
    """Every column of the school-year cells back on every row (J11); rows without a school or year meet their own cell.

    The cells are a small table (schools x years); Spark broadcasts it when its
    measured size allows.
    """
    named = cells.select(F.col("unitid").alias("_unitid"), F.col("year_to").alias("_year"), *CELL_COLUMNS)
    same = F.col("unitid").eqNullSafe(F.col("_unitid")) & F.col("year_to").eqNullSafe(F.col("_year"))
    return panel.join(named, same, "left").drop("_unitid", "_year")


def finance_overall(cells: DataFrame) -> DataFrame:
    """Means of the shares and totals of the estimated counts."""
    return cells.agg(
        F.avg("avg_prob_finance_broad").alias("mean_finance_broad"),
        F.avg("avg_prob_wallstreet").alias("mean_wallstreet"),
        F.sum("est_count_finance_broad").alias("total_finance_broad"),
        F.sum("est_count_wallstreet").alias("total_wallstreet"),
    )


def top_finance_schools(cells: DataFrame, k: int = 15) -> DataFrame:
    """Schools with the largest estimated count (C47, T2); the limit is the report."""
    totals = cells.where(F.col("unitid").isNotNull()).groupBy("unitid").agg(
        F.coalesce(F.sum("est_count_wallstreet"), F.lit(0.0)).alias("est_count_wallstreet")
    )
    return totals.orderBy(F.desc("est_count_wallstreet"), "unitid").limit(k)
