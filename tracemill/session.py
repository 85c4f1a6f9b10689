"""SparkSession factory used by tests, the bench and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tracemill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a local master gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in a scratch folder, so that several plans read it and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
