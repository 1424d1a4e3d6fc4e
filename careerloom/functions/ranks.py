"""Exact ranks and percentiles without a one-task sort or a whole-column buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerloom.session import stored

#: Rows of which the sketch may miss one rank; a bracket reaches twice as far on either side of its probe.
ACCURACY = 20_000
#: Even cuts of a running total.
EVEN = 255


def _cell(cuts: str, value: str, n_cuts: int) -> Column:
    """Number of cuts below the value, found by halving.  Missing cuts count as above it."""
    cell = F.lit(0)
    step = 1 << (max(1, n_cuts).bit_length() - 1)
    while step:
        cell = cell + F.when(F.get(F.col(cuts), cell + (step - 1)) < F.col(value), step).otherwise(0)
        step //= 2
    return cell


def _with_cells(df: DataFrame, group: str, value: str, at: Sequence[float]) -> DataFrame:
    """``_cell`` of each row: the line is cut at approximate percentiles of the group's values.

    The cuts, one row per group, are stored, so Spark knows their size when it
    chooses the join.
    """
    probes = F.array(*[F.lit(float(p)) for p in sorted({min(1.0, max(0.0, p)) for p in at})])
    cuts = df.groupBy(group).agg(F.percentile_approx(value, probes, F.lit(ACCURACY)).alias("_cuts"))
    cuts = stored(cuts.select(group, F.array_distinct("_cuts").alias("_cuts")), "cuts")
    return df.join(cuts, group).withColumn("_cell", _cell("_cuts", value, len(at))).drop("_cuts")


def _offsets(cells: DataFrame, group: str, weights: Sequence[str]) -> DataFrame:
    """Weight totals of each cell, and ``_<w>_off``, those of the cells before it."""
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(group, "_cell").agg(*[F.sum(w).alias(f"_{w}_in") for w in weights])
    return totals.select("*", *[F.coalesce(F.sum(f"_{w}_in").over(before), F.lit(0)).alias(f"_{w}_off") for w in weights])


def _before(cells: DataFrame, group: str, value: str, weights: Sequence[str]) -> list[Column]:
    inside = Window.partitionBy(group, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return [(F.coalesce(F.sum(w).over(inside), F.lit(0)) + F.col(f"_{w}_off")).alias(f"{w}_before") for w in weights]


def running_totals(df: DataFrame, group: str, value: str, weights: Sequence[str]) -> DataFrame:
    """Per distinct ``value``: its weight totals, and ``<w>_before``, the total of all smaller values.

    The rows are first summed per distinct value.  Approximate percentiles of
    the distinct values cut them into even cells; a running sum inside a cell
    plus the totals of the cells before it is the exact running sum.
    """
    sums = df.groupBy(group, value).agg(*[F.sum(w).alias(w) for w in weights])
    placed = _with_cells(sums, group, value, [i / (EVEN + 1) for i in range(1, EVEN + 1)])
    offsets = stored(_offsets(placed, group, weights), "offsets").select(group, "_cell", *[f"_{w}_off" for w in weights])
    joined = placed.join(offsets, [group, "_cell"])
    return joined.select(group, value, *weights, *_before(joined, group, value, weights))


def exact_percentiles(
    df: DataFrame, group: str, value: str, probes: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Columns ``group, p, value``: linearly interpolated percentiles of non-null values.

    With n values the percentile p sits at position p*(n-1).  A sketch brackets
    each probe; one counting pass sums the rows between the bounds of the
    brackets, a few numbers per task; only the values of the cells that hold a
    wanted position are then summed and ranked, about n / ACCURACY of them per
    probe.  The sketch is never trusted: the counts say which cell holds a
    position, wherever its bounds lie.  ``weight`` counts how often a row
    stands; rows of very uneven weight make uneven cells, no wrong ones.
    """
    counted = df.where(F.col(value).isNotNull()).select(
        group, F.col(value).cast("double").alias("value"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")
    )
    reach = 2.0 / ACCURACY
    even = [i / 16 for i in range(1, 16)] if weight else []
    placed = _with_cells(counted, group, "value", [*[p - reach for p in probes], *[p + reach for p in probes], *even])
    cells = stored(_offsets(placed, group, ["n"]), "cells")
    size = cells.groupBy(group).agg(F.sum("_n_in").alias("size"))
    wanted = size.select(group, F.explode(F.array(*[F.lit(float(p)) for p in probes])).alias("p"), "size").select(
        group, "p", (F.col("p") * (F.col("size") - 1)).alias("at")
    ).withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    last = F.col("_n_off") + F.col("_n_in") - 1
    holds = F.col("low").between(F.col("_n_off"), last) | F.col("high").between(F.col("_n_off"), last)
    asked = stored(cells.join(wanted, group).where(holds).select(group, "_cell", "_n_off", "p", "at", "low", "high"), "asked")
    open_cells = asked.select(group, "_cell", "_n_off").distinct()
    inside = placed.join(open_cells, [group, "_cell"]).groupBy(group, "_cell", "_n_off", "value").agg(F.sum("n").alias("n"))
    ranked = inside.select(group, "_cell", "value", "n", *_before(inside, group, "value", ["n"]))
    last = F.col("n_before") + F.col("n") - 1
    answers = ranked.join(asked.drop("_n_off"), [group, "_cell"]).where(
        F.col("low").between(F.col("n_before"), last) | F.col("high").between(F.col("n_before"), last)
    )
    return answers.groupBy(group, "p", "at", "low").agg(F.min("value").alias("v0"), F.max("value").alias("v1")).select(
        group, "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("low"))).alias("value")
    )
