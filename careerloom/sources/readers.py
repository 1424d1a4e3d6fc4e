"""Scans (S1-S9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from careerloom import schemas
from careerloom.operators.relational import only_unrepeated


def csv_table(spark: SparkSession, path: str | list[str], schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV scan that parses only the listed columns."""
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=False)
    return df.select(*columns) if columns else df


def tolerant_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """CSV scan that drops malformed lines, undoubles quotes and trims after the delimiter."""
    return spark.read.schema(schema).csv(
        path, header=True, mode="DROPMALFORMED", quote='"', escape='"', ignoreLeadingWhiteSpace=True, encoding="UTF-8"
    )


def malformed_csv_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """The lines that ``tolerant_csv`` drops, in column ``line``."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    read = spark.read.schema(wide).csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", quote='"', escape='"',
        ignoreLeadingWhiteSpace=True, encoding="UTF-8",
    )
    # a line is only known to be broken once all its columns are parsed, so the filter must need them all
    parsed = F.to_json(F.struct(*schema.names)).isNotNull()
    return read.where(F.col("_bad").isNotNull() & parsed).select(F.col("_bad").alias("line"))


def inferred_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with inferred types (S4): an extra pass over the file, so prefer ``csv_table``."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')


def many_files(spark: SparkSession, *patterns: str) -> DataFrame:
    """Every Parquet file matching the patterns, as one table."""
    return spark.read.option("mergeSchema", "true").parquet(*patterns)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str, format: str = "parquet") -> bool:
    """Whether a readable table is stored at the path."""
    try:
        spark.read.format(format).load(path)
        return True
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def optional_snapshot(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table, or None when it is not there (S9): operators then pass their input through."""
    return snapshot(spark, path) if path and exists(spark, path) else None


def universities(df: DataFrame) -> DataFrame:
    """Reference dimension without the names that occur more than once."""
    return only_unrepeated(df, "instnm")


def label_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines of labels; blank, broken and nameless lines are skipped."""
    schema = StructType([*schemas.LABEL_LINE.fields, StructField("_bad", StringType())])
    read = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return read.where(F.col("_bad").isNull() & F.col("company_name").isNotNull()).drop("_bad")
