"""Labelling names in batches with a caller-supplied labeler, and resuming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerloom.functions.replies import json_list, known_label, reply_items
from careerloom.functions.text import strip
from careerloom.operators.relational import hash_bucket, keep_first, not_in_keys
from careerloom.sources.readers import exists
from careerloom.sources.writers import append_log

#: Takes the JSON list of names of one batch, returns the reply text.
Labeler = Callable[[str], str]


def name_batches(names: DataFrame, size: int = 50, name: str = "company_name", buckets: int | None = None) -> DataFrame:
    """``bucket, batch, names, request``: batches of at most ``size`` distinct names.

    Names are numbered inside hash buckets, which distinct names fill evenly,
    so no task sees all names; each bucket ends with one short batch.
    """
    spark = names.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("bucket").orderBy(name)
    numbered = (
        names.select(name)
        .where(F.col(name).isNotNull())
        .distinct()
        .withColumn("bucket", hash_bucket(name, buckets))
        .withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    )
    return numbered.groupBy("bucket", "batch").agg(F.array_sort(F.collect_list(name)).alias("names")).withColumn(
        "request", json_list("names")
    )


def label_batches(batches: DataFrame, labeler: Labeler) -> DataFrame:
    """Reply of the labeler to each batch (M10, D6).  Task retries may ask again for a batch."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["reply"] = [labeler(request) for request in frame["request"]]
            yield frame[["bucket", "batch", "reply"]]

    return batches.select("bucket", "batch", "request").mapInPandas(ask, "bucket long, batch long, reply string")


def parsed_labels(replies: DataFrame, allowed: list[str], default: str | None) -> DataFrame:
    """One row per labelled name of the replies; unknown labels become the default."""
    return replies.select(F.inline(reply_items("reply"))).where(F.col("company_name").isNotNull()).select(
        strip("company_name").alias("company_name"),
        known_label("label", allowed, default).alias("label"),
        "confidence",
        "reason",
    )


def label_names(names: DataFrame, labeler: Labeler, allowed: list[str], default: str | None = None, size: int = 50) -> DataFrame:
    """Batch, ask, parse."""
    return parsed_labels(label_batches(name_batches(names, size), labeler), allowed, default)


LOG_SCHEMA = "company_name string, label string, confidence double, reason string, run long"


def label_log(spark: SparkSession, path: str) -> DataFrame:
    """The progress log; an absent one is empty, broken lines are skipped."""
    if not exists(spark, path, "text"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA + ", _bad string").json(path, columnNameOfCorruptRecord="_bad").where(
        F.col("_bad").isNull() & F.col("company_name").isNotNull()
    ).drop("_bad")


def resume_labels(
    names: DataFrame, path: str, labeler: Labeler, allowed: list[str], default: str | None = None, size: int = 50
) -> DataFrame:
    """Label only the names the log does not have, append, return the latest label per name.

    A second run over the same names asks nothing and changes nothing.
    """
    spark = names.sparkSession
    remaining = not_in_keys(names.select("company_name").distinct(), label_log(spark, path), "company_name")
    fresh = label_names(remaining, labeler, allowed, default, size).withColumn("run", F.lit(time.time_ns()))
    append_log(fresh, path)
    return latest_labels(label_log(spark, path))


def latest_labels(log: DataFrame) -> DataFrame:
    """Newest record of each name."""
    return keep_first(log, "company_name", [F.desc("run")])


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels received, per label."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))
