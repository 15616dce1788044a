"""Reading source files and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import source_schema
from adloom.operators.features import manifest
from adloom.operators.importance import top_features
from adloom.operators.monitor import group_importance
from adloom.operators.ranks import numbered
from adloom.operators.staging import batch_metrics, missing_profile
from adloom.operators.tables import replace_batch


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files of 40 columns with a header line."""
    return spark.read.schema(source_schema()).option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Files of 40 tab-separated columns without a header."""
    return spark.read.schema(source_schema()).option("sep", "\t").csv(path)


#: Ids that a batch has to itself.
BATCH_IDS = 1 << 40


def load_raw(source: DataFrame, batch_id: int, ingested_at: Column | None = None) -> DataFrame:
    """A file's rows as raw impressions: empty values are null; an id, its batch, its file and the time of loading. Ids number the rows in
    the order of the file and begin at batch_id * BATCH_IDS, so they are unique over all batches and don't depend on how files are split."""
    names = {c: c.lower() for c in source.columns if c not in ("source_file", "_metadata")}
    columns = [F.nullif(F.col(c), F.lit("")).alias(n) if n.startswith("c") else F.col(c).alias(n) for c, n in names.items()]
    file = F.col("source_file") if "source_file" in source.columns else F.col("_metadata.file_name")
    rows = source.select(F.lit(batch_id).cast("long").alias("batch_id"), *columns, file.alias("source_file"), (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"))
    return numbered(rows, "event_id", batch_id * BATCH_IDS)


def reconcile(loaded: DataFrame, expected: DataFrame) -> DataFrame:
    """(batch_id, expected_row_count, loaded_row_count, load_status): what each batch should hold and holds; batches that are missing on either
    side are mismatches."""
    counts = loaded.groupBy("batch_id").agg(F.count(F.lit(1)).alias("loaded_row_count"))
    j = expected.select("batch_id", "expected_row_count").join(counts, "batch_id", "full")
    e, n = F.coalesce("expected_row_count", F.lit(0)), F.coalesce("loaded_row_count", F.lit(0))
    return j.select("batch_id", e.alias("expected_row_count"), n.alias("loaded_row_count"), F.when(e == n, "MATCH").otherwise("MISMATCH").alias("load_status"))


def require_match(reconciled: DataFrame) -> None:
    bad = reconciled.where("load_status = 'MISMATCH'").limit(5).collect()
    if bad:
        raise ValueError(f"row counts don't match: {bad}")


def write_batch(df: DataFrame, path: str) -> DataFrame:
    """Replaces df's batches at path and reads the table back."""
    replace_batch(df, path)
    return df.sparkSession.read.parquet(path)


def write_metrics(staged: DataFrame, path: str) -> None:
    batch_metrics(staged).write.mode("overwrite").json(path)


def write_missing_profile(raw: DataFrame, path: str) -> None:
    missing_profile(raw).write.mode("overwrite").option("header", True).csv(path)


def write_splits(split: DataFrame, path: str) -> None:
    split.write.mode("overwrite").partitionBy("dataset_split").parquet(path)
    manifest(split.sparkSession.read.parquet(path)).write.mode("overwrite").json(f"{path}_manifest")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "model_version").parquet(path)


def write_importance(frame: DataFrame, path: str, top_n: int = 25) -> None:
    """The full list, the first n, and sums by group."""
    for name, df in (("all", frame), ("top", top_features(frame, top_n)), ("groups", group_importance(frame))):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
