"""DataFrame helpers: columns by exact name, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str, optional: dict[str, str] | None = None) -> DataFrame:
    """The named columns and nothing else, found by exact name.

    Other columns may differ from these only in case, or repeat a name; they never make a
    reference ambiguous. ``optional`` maps names that may be absent to the type of their NULLs.
    """

    have = list(df.columns)
    frame = df.toDF(*[f"c{i}" for i in range(len(have))])
    columns = []
    for name in names:
        if name in have:
            columns.append(F.col(f"c{have.index(name)}").alias(name))
        elif optional and name in optional:
            columns.append(F.lit(None).cast(optional[name]).alias(name))
        else:
            raise ValueError(f"the input has no column {name}")
    return frame.select(*columns)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    A local master without that setting (a test) gets a temporary folder, for it is one machine.
    """

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at a Parquet table in the shared folder; the table read back."""

    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which bucket counts are sized."""

    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> list[Column]:
    """Two independent 64-bit hashes of the column ``text``: equal texts, equal keys; NULL counts as empty."""

    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit("second"), text).alias("key_b")]
