"""The corpus pipeline: documents through quality, exact and near duplicates, mixing and encoding.

Each stage takes (spark, docs, sf_dir), reads all rows its predecessor kept and returns a table that is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

A stage owns the tables it stores on the way. They are given back when the next stage is called, as by then its own
output is written and read again; what the given ``docs`` still reads is left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm import bpe, exact_dedup, jaccard, mixing, quality
from careerloom.llm.common import numbered, read, stored
from careerloom.llm.queries import vocabulary_path
from careerloom.session import emptied, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage stored on its way.
_left: list[str] = []


def _owner(stage: Stage) -> Stage:
    """The stage with the tables of the stage before given back first, and its own kept in mind."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {path: path.rsplit("/", 1)[1] for path in _left}
        read_on = {name for name in names.values() if any(f"/{name}/" in file for file in docs.inputFiles())}
        emptied(spark, [path for path, name in names.items() if name not in read_on])
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _left[:] = [*[path for path, name in names.items() if name in read_on], *paths]
        return out

    return run_stage


def _keep(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the numbered ``docs`` whose ``_row`` is listed: ids may be null, repeat, or stand for several texts."""
    return docs.join(rows.select("_row"), "_row", "left_semi").drop("_row")


@_owner
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = numbered(docs, from_files=True)
    return _keep(docs, quality.quality_scores(docs, read(spark, sf_dir, "labels"), also=("_row",)).where("predicted = 1"))


@_owner
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that share the kept id and length, the first by text digest."""
    docs = numbered(docs, from_files=True)
    digest = F.sha2(exact_dedup.normalised().cast("binary"), 256)
    length = F.length(F.coalesce("text", F.lit("")))
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    order = F.struct((-length).alias("length"), F.xxhash64("text").alias("digest"), F.col("_row").alias("row"))
    rows = docs.select("doc_id", digest.alias("sha"), "_row", order.alias("order"))
    rows = rows.groupBy("doc_id", "sha").agg(F.min("order").alias("order"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    return _keep(docs, rows.select(F.col("order.row").alias("_row")))


@_owner
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of near-equal shingle sets connect: the one with the smallest id, nulls last."""
    docs = numbered(docs, from_files=True)
    found = jaccard.components(docs.select(F.col("_row").alias("doc_id"), "text"), **jaccard.NEAR)
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.col("_row").alias("row"))
    placed = docs.select("_row", order.alias("order")).join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    return _keep(docs, placed.groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.row").alias("_row")))


@_owner
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; documents taken twice come twice."""
    return mixing.mixed_documents(docs, from_files=True)


@_owner
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and digests of every document of the mix."""
    return bpe.encoded(docs, vocabulary_path(), keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Training, components and token merging cannot be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next reads it."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as now:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        emptied(spark, before)
        before = now[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
