"""Exact percentiles, running totals and AUC against numpy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerloom.functions.ranks import exact_percentiles, running_totals
from careerloom.operators import profiling
from careerloom.operators.embedding import rank_auc


def sample(seed, n, ties):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=n)
    return np.round(values, 1) if ties else values


@pytest.mark.parametrize("n,ties", [(1, False), (2, False), (7, True), (3000, False), (3000, True)])
def test_percentiles(spark, n, ties):
    values = sample(3, n, ties)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("h", 5.0)], "g string, v double")
    probes = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in exact_percentiles(df, "g", "v", probes).collect()}
    for p in probes:
        assert got[("g", p)] == pytest.approx(np.quantile(values, p))
        assert got[("h", p)] == 5.0


def test_one_value_holding_most_rows(spark):
    values = [0.0] * 4000 + list(range(1, 1000))
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double").repartition(5)
    got = {r.p: r.value for r in exact_percentiles(df, "g", "v", [0.5, 0.81, 0.999]).collect()}
    assert got == {p: pytest.approx(np.quantile(values, p)) for p in (0.5, 0.81, 0.999)}


def test_running_totals(spark):
    values = sample(5, 2000, True)
    df = spark.createDataFrame([("g", float(v), 2) for v in values], "g string, v double, w int")
    for r in running_totals(df, "g", "v", ["w"]).collect():
        assert r.w == 2 * (values == r.v).sum() and r.w_before == 2 * (values < r.v).sum()


@pytest.mark.parametrize("ties", [False, True])
def test_auc(spark, ties):
    score, y = sample(8, 300, ties), np.random.default_rng(9).integers(0, 2, 300)
    df = spark.createDataFrame([(float(s), int(k)) for s, k in zip(score, y)] + [(None, 1), (0.1, None)], "s double, y int")
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    want = ((a > b).sum() + (a == b).sum() / 2) / (a.size * b.size)
    assert rank_auc(df, "s", "y").first().auc == pytest.approx(want)


def test_numeric_extras_match_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": sample(1, 500, True), "b": np.arange(500) % 7})
    got = profiling.numeric_extras(spark.createDataFrame(pdf)).toPandas().set_index("column")
    for c in pdf:
        assert got.loc[c, "median"] == pytest.approx(pdf[c].median())
        assert got.loc[c, "mode"] == pytest.approx(pdf[c].mode().iloc[0])
        assert got.loc[c, "variance"] == pytest.approx(pdf[c].var())
        assert got.loc[c, "skewness"] == pytest.approx(pdf[c].skew())
        assert got.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurtosis())


def test_profile_of_small_tables(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, None, None)], "a int, s string, z string")
    quality = {r.metric: r.value for r in profiling.row_quality(df, 0.5).collect()}
    assert quality["empty_rows"] == 1 and quality["mostly_empty_rows"] == 1
    assert quality["completeness_pct"] == pytest.approx(100 * 4 / 9)
    assert profiling.duplicate_rows(df).first().n_duplicates == 1
    assert tuple(profiling.id_uniqueness(df, "a").first()) == (3, 1, 2)
    assert {r.metric: r.value for r in profiling.overview(df).collect()}["columns of type string"] == 2
    assert profiling.missing_values(df, 1).first().column == "z"
    typed = profiling.binary_to_int(df.withColumn("f", F.lit(True)).withColumn("k", F.lit(2)))
    assert dict(typed.dtypes) == {"a": "bigint", "s": "string", "z": "string", "f": "bigint", "k": "int"}
