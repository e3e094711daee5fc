"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.numeric import number


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    date_column: str | None = None,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Parquet with only the wanted columns and a date range that prunes partitions or row groups."""

    df = spark.read.parquet(path)
    if date_column is not None:
        if first is not None:
            df = df.where(F.col(date_column) >= F.lit(first).cast("timestamp"))
        if last is not None:
            df = df.where(F.col(date_column) < F.lit(last).cast("timestamp"))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a given schema; doubles keep their exact value."""

    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON documents (one per line, or one per file with ``multiline``) with a given schema."""

    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def opened(documents: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """One row per record of an array of records inside each document."""

    return documents.select(*keys, F.inline(array))


def header_gaps(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required column names that a table lacks (metadata only, no data is read)."""

    have = {name.strip().lower() for name in df.columns}
    return sorted(name for name in required if name.lower() not in have)


def write_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Deterministic CSV: range-sorted by key, header, shortest exact decimals, LF lines."""

    df.orderBy(*keys).write.option("header", True).option("lineSep", "\n").csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Columns in name order, NaN and NULL alike written as null."""

    columns = []
    for field in sorted(df.schema.fields, key=lambda item: item.name):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = number(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; missing numbers stay visible as null."""

    json_ready(df).write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """The default sink, optionally partitioned (for example by decision date)."""

    df.write.partitionBy(*partition_by).parquet(path)
