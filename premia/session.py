"""Session for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("premia")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a folder of this machine.
    """

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir=tempfile.gettempdir())
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex[:12]}")


#: Setting that makes a query remove its shuffle files when it ends; by default they stay until the driver's collector finds them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df, name: str):
    """Cut lineage through a parquet table in the shared folder, whose shuffle files go when it is written; returns it read back."""

    spark = df.sparkSession
    path = scratch_folder(spark, name)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""

    return int(spark.conf.get("spark.sql.shuffle.partitions"))
