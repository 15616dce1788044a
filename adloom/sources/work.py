"""Places for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a wide table's files that one task reads: some 300,000 rows of staging, which take 30 times as many bytes as rows that are sorted or written.
TASK_BYTES = "16m"


def compiled(spark: SparkSession) -> None:
    """Projections of a hundred columns make methods that the JVM doesn't compile; with the first setting Spark splits them. With the second a task's rows, and
    so the memory of its sorts and writers, have a bound that Spark's 128 MB, of compressed columns, don't give. Set for the session, unless it has
    settings of its own."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b") in ("134217728b", "134217728", "128m", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a new local folder where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-adloom-')}")
        base = spark.sparkContext.getCheckpointDir()
    return base


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the written table, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
