"""Null, duplicate and skew rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careerloom.operators import relational as rel
from careerloom.operators.relational import Skew
from conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a fifth without a key, exact copies among them."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 5 == 0 else f"k{rng.randrange(900)}"
        data.append((key, i % 11))
    return spark.createDataFrame(data, "k string, v int").repartition(6), data


def test_skew_is_measured(skewed):
    skew = rel.measure_skew(skewed[0], "k")
    assert skew.values == ("hot",) and skew.pieces >= 2


def test_no_skew_means_a_plain_join(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    assert not rel.measure_skew(df, "k").found
    plan = rel.enrich(df, df.distinct(), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" not in plan


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("skew", [None, Skew(), Skew(("hot",), 7), Skew((), 5)])
def test_enrich_equals_plain_lookup(spark, skewed, how, skew):
    df, data = skewed
    dim = {k: len(k) for k, _ in data if k and not k.endswith("3")}
    table = spark.createDataFrame(list(dim.items()), "k string, n int")
    want = [(k, v, dim.get(k)) for k, v in data if how == "left" or k in dim]
    assert rows(rel.enrich(df, table, "k", how, skew)) == sorted(want, key=repr)


def test_hot_rows_are_spread_over_tasks(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dim = skewed[0].select("k").distinct().where("k is not null").withColumn("n", F.lit(1))
        out = rel.enrich(skewed[0], dim, "k").withColumn("task", F.spark_partition_id())
        assert out.where("k = 'hot'").select("task").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_semi_and_anti_partition_the_rows(spark, skewed):
    df, data = skewed
    keys = spark.createDataFrame([("hot",), ("k1",), ("k1",), (None,)], "k string")
    inside, outside = rel.in_keys(df, keys, "k"), rel.not_in_keys(df, keys, "k")
    assert rows(inside) == sorted([r for r in data if r[0] in ("hot", "k1")], key=repr)
    assert rows(inside.unionByName(outside)) == sorted(data, key=repr)


def test_keep_first_is_idempotent_and_limited_on_the_map_side(spark):
    data = [(1, "b", 2), (1, "a", 9), (None, "x", 1), (None, None, 5), (2, "c", 0), (2, "c", 0)]
    df = spark.createDataFrame(data, "k int, s string, n int")
    once = rel.keep_first(df, "k")
    assert rows(once) == sorted([(1, "a", 9), (None, None, 5), (2, "c", 0)], key=repr)
    assert rows(rel.keep_first(once, "k")) == rows(once)
    plan = rel.keep_first(df, "k")._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan only
    assert plan.count("WindowGroupLimit") == 2 and "row_number(), 1, Partial" in plan


def test_keep_last(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, s string, run int")
    assert rel.keep_first(df, "k", [F.desc("run")]).first().s == "new"


def test_repeat_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k int, s string")
    assert rows(rel.repeat_counts(df, "k")) == sorted([(1, "a", 2, 1), (1, "b", 1, 1), (2, "c", 1, 0), (None, "d", 2, 1)], key=repr)


def test_only_unrepeated(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "u int, name string")
    assert rows(rel.only_unrepeated(df, "name")) == [(2, "b")]


def test_required_uniqueness_fails_the_job(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    assert rows(rel.require_unique(good, "k")) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="not unique"):
        rel.require_unique(good.unionByName(good), "k").collect()


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, None, 1), ("b", 2, None)], "s string, x int, y int")
    assert df.where(rel.not_in("s", ["a"])).count() == 2
    assert df.where(rel.any_differs(["x", "y"])).count() == 2
    assert rows(df.select(rel.share(F.lit(1), F.lit(0)))) == [(None,)] * 3


def test_samples(spark):
    df = spark.range(500).select(F.concat(F.lit("n"), "id").alias("name"))
    a, b = rel.sample_n(df, 40, "name", 1), rel.sample_n(df, 40, "name", 2)
    assert a.count() == 40 and rows(a) == rows(rel.sample_n(df.repartition(7), 40, "name", 1)) and rows(a) != rows(b)
    parts = rel.two_samples(df, 100, "name").groupBy("part").count()
    assert rows(parts) == [("test", 100), ("train", 100)]
    assert rel.two_samples(df, 100, "name").select("name").distinct().count() == 200
    assert rel.sample_n(df, 9999, "name").count() == 500


def test_natural_join_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        rel.natural_join(spark.range(1), spark.range(1).toDF("x"))


def test_union_fills_missing_columns(spark):
    out = rel.union_all(spark.range(1).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2)))
    assert rows(out) == sorted([(0, 1, None), (0, None, 2)], key=repr)


def test_first_k_beyond_the_group_limit(spark):
    df = spark.range(30_000).selectExpr("id", "if(id % 10 < 7, 'a', if(id % 10 < 9, 'b', null)) AS label", "(id * 7919) % 30011 AS v").repartition(6)
    got = rel.first_k(df, "label", 5000, ["v"])
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.v):
        want.setdefault(r.label, []).append(r.id)
    have = {}
    for r in got.collect():
        have.setdefault(r.label, set()).add(r.id)
    assert have == {k: set(v[:5000]) for k, v in want.items()} and len(have["a"]) == len(have["b"]) == 5000 and len(have[None]) == 3000


def test_long_texts_are_embedded_in_blocks_of_bounded_size(spark):
    from careerloom.operators import embedding

    names = spark.range(1024).select("id", F.repeat(F.lit("x" * 65_535 + " "), 4).alias("text"))
    vocab = spark.createDataFrame([("x", [1.0, 2.0])], "word string, vec array<double>")
    plan = embedding.embed_names(names, vocab, "text", 2, key="id")._jdf.queryExecution().optimizedPlan().toString()
    blocks = int(re.search(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan).group(1))
    assert blocks * 17_000_000 >= 1024 * 4 * 65_536


def _brute_means(names, vectors, size):
    """(key, mean of the vectors of the words that have one, nulls as 0) for every row of ``names``."""
    out = []
    for key, text in names:
        known = [vectors[w] for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w in vectors]
        out.append((key, [sum((v or [0] * size)[i] or 0 for v in known) / len(known) if known else 0.0 for i in range(size)]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shared", [False, True])
def test_vectors_go_to_groups_of_blocks(spark, monkeypatch, shared):
    """More than 64 groups, several blocks to a group, keys that repeat or are null, words and ids without a vector, null vectors and numbers."""
    from careerloom.operators import embedding

    monkeypatch.setattr(embedding, "GROUP_CHARS", 64)
    monkeypatch.setattr(embedding, "BLOCK_CHARS", 16)
    names = [(i % 190 if i % 7 else None, f"w{i % 23} w{i % 23}\tw{i % 5}\x0bé{i % 3}  x y\n" * (i % 4)) for i in range(300)]
    ids = {f"w{i}": i % 4 for i in range(23)} | {"é0": 9, "é1": None, "x y": 3}
    table = {0: [1.0, 2.0], 1: [0.5, None], 2: None, 3: [4.0, 0.25]}
    of_word = {w: table[i] for w, i in ids.items() if i in table}
    docs = spark.createDataFrame(names + [(1, None)], "id int, text string")
    if shared:
        vocab = spark.createDataFrame(list(ids.items()), "word string, vec_id int")
        vectors = spark.createDataFrame([*table.items(), (3, table[3])], "vec_id int, vec array<float>")
    else:
        vocab, vectors = spark.createDataFrame([*of_word.items(), (None, [7.0, 7.0])], "word string, vec array<double>"), None
    got = embedding.embed_names(docs, vocab, "text", 2, key="id", vectors=vectors)
    assert got.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] > 63
    have, want = sorted(((r.id, list(r.embedding)) for r in got.collect()), key=repr), _brute_means(names, of_word, 2)
    assert [k for k, _ in have] == [k for k, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, x), (_, y) in zip(have, want) for a, b in zip(x, y))


def test_word_vectors_are_not_stored_for_each_word(spark, sf):
    from pathlib import Path

    from careerloom.plans.catalogue import QUERIES
    from careerloom.session import recorded

    with recorded() as paths:
        out = QUERIES["name_embedding"](spark, sf)
    words = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("explode(split(text, '\\\\s+')) AS w").distinct().count()
    assert out.count() == 64 * spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").count()
    assert sum(p.stat().st_size for path in paths for p in Path(path).rglob("*.parquet")) < words * 64


def test_vectors_beyond_memory_lie_in_a_file(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from careerloom.operators import embedding

    monkeypatch.setattr(embedding, "VECTOR_BYTES", 100)
    held = embedding._Vectors(3)
    rows = np.arange(60, dtype=np.float32).reshape(20, 3)
    for lo in range(0, 20, 4):
        held.add(pa.array(rows.tolist(), pa.list_(pa.float32())).slice(lo, 4))
    assert isinstance(held.matrix(), np.memmap) and (held.matrix() == rows).all()
