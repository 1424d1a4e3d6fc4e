"""Sinks (K1-K7)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from careerloom.session import scratch_path


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the stored table (K1).

    A table computed from the very path it replaces is written beside it
    first, so the old data is still there while it is being read.
    """
    spark = df.sparkSession
    root = re.sub("^[a-z]+:/*", "/", path.rstrip("/")) + "/"
    if any(re.sub("^[a-z]+:/*", "/", f).startswith(root) for f in df.inputFiles()):
        staged = scratch_path(spark, "staged")
        df.write.parquet(staged)
        df = spark.read.parquet(staged)
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line (K2)."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def file_sizes(spark: SparkSession, path: str, suffix: str = "parquet") -> DataFrame:
    """Columns ``path, length`` of the data files; the listing only, no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{suffix}")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )


def write_size_capped(
    df: DataFrame, path: str, max_bytes: float = 1.8 * 1024**3, safety: float = 0.95, rows_per_file: int | None = None
) -> int | None:
    """Parts no larger than ``max_bytes`` (K3); returns the records-per-file limit in use.

    The table is written once, and parts within the cap stay as they are.  Rows
    of larger parts, found by the size in their file metadata, are cut beside
    the table, with Spark rolling to a new file at the number of records that
    the densest part allows; the input is not computed again.  When all cuts
    fit they are added and the parts that they replace go.  An empty table
    still gives one part.
    """
    spark = df.sparkSession

    def limited(writer: DataFrameWriter) -> DataFrameWriter:
        return writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer

    def too_large(folder: str) -> DataFrame:
        return spark.read.schema(df.schema).parquet(folder).where(F.col("_metadata.file_size") > max_bytes)

    limited(df.write.mode("overwrite")).parquet(path)
    whole = [f.path for f in file_sizes(spark, path).where(F.col("length") > max_bytes).select("path").toLocalIterator()]
    densest = bytes_per_row(too_large(path))
    if densest is None or rows_per_file == 1:
        return rows_per_file
    while densest is not None and rows_per_file != 1:
        fitting = math.floor(max_bytes * safety / densest)
        rows_per_file = max(1, fitting if rows_per_file is None else min(fitting, rows_per_file - 1))
        cut = scratch_path(spark, "cut")
        limited(too_large(path).write).parquet(cut)
        densest = bytes_per_row(too_large(cut))
    limited(spark.read.parquet(cut).write.mode("append")).parquet(path)
    remove_files(spark, whole)
    return rows_per_file


def bytes_per_row(parts: DataFrame) -> float | None:
    """Bytes a row takes in the densest of the files read, None if there are none; only footers are read."""
    files = parts.groupBy("_metadata.file_path").agg((F.max("_metadata.file_size") / F.count("*")).alias("density"))
    return files.agg(F.max("density")).first()[0]


def remove_files(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes files of a table by the file system that holds them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in paths:
        place = hadoop.Path(name)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Column descriptions as metadata, only for columns present (K4)."""
    for name, text in labels.items():
        if name in df.columns:
            df = df.withMetadata(name, {"comment": text})
    return df


def data_dictionary(df: DataFrame) -> DataFrame:
    """Columns ``column, type, label`` of a table, one row per column (K4)."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, type string, label string")


def write_labelled(df: DataFrame, path: str, labels: Mapping[str, str]) -> None:
    """The table with its column descriptions, and the dictionary table beside it (K4)."""
    labelled = with_labels(df, labels)
    write_snapshot(labelled, path)
    data_dictionary(labelled).write.mode("overwrite").parquet(path.rstrip("/") + "_dictionary")


def narrowed(df: DataFrame) -> DataFrame:
    """Types every external tool reads: booleans as 0/1, nested values as JSON text (K5)."""
    def plain(f) -> Column:
        if isinstance(f.dataType, BooleanType):
            return F.col(f.name).cast("int").alias(f.name)
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name)

    return df.select(*[plain(f) for f in df.schema])


def write_export(df: DataFrame, path: str) -> None:
    """Hand-off table for external tools, as CSV (K5)."""
    write_csv(narrowed(df), path)


def run_date() -> Column:
    """Run date as text."""
    return F.date_format(F.current_date(), "yyyyMMdd")


def write_dated(df: DataFrame, path: str) -> None:
    """One version per run date; a second run on the same day replaces only that day (K6).

    A manifest beside the table gets a row per version, after its data, so a
    version that failed half-way is not listed.
    """
    spark = df.sparkSession
    day = spark.range(1).select(run_date()).first()[0]

    def put(table: DataFrame, to: str) -> None:
        dated = table.withColumn("snapshot_date", F.lit(day))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(to)

    put(df, path)
    put(spark.range(1).select(F.current_timestamp().alias("written_at")), versions_path(path))


def versions_path(path: str) -> str:
    return path.rstrip("/") + "_versions"


def latest_dated(spark: SparkSession, path: str) -> DataFrame:
    """The newest version written by ``write_dated``.

    The manifest, one row per version, names it; only its folder is listed and read.
    """
    newest = spark.read.parquet(versions_path(path)).agg(F.max("snapshot_date")).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/snapshot_date={newest}")


def append_log(df: DataFrame, path: str) -> None:
    """Append result records as JSON lines (K7)."""
    df.write.mode("append").json(path)
