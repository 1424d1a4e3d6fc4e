"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators were tuned with; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "careerloom", **extra: str) -> SparkSession:
    """Session with the defaults above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    folder = tempfile.mkdtemp(prefix="careerloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``stored`` writes inside the block: their owner is who opened it."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def emptied(spark: SparkSession, paths: Iterable[str]) -> None:
    """Gives back the disk of stored tables that nothing reads any more; an empty table stays in each place."""
    for path in paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The table written to the shared folder, with the writer's ``options``, and read back.

    Used where several branches of a plan start from one costly table: it is
    computed once, a lost executor costs no recomputation of it, and the plans
    after it stay small.
    """
    path = scratch_path(df.sparkSession, name)
    for paths in _recorders:
        paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """The table stored in buckets of ``key``, sorted by it inside each.

    One shuffle, at the writing.  Windows and aggregates over keys that contain
    ``key``, and joins of two such tables on it, then need none.  The table is
    an external one below the shared folder; its name is of this session only.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").option("path", scratch_path(spark, name))
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
