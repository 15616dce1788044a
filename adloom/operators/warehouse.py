"""The star schema: dimensions, facts and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions import exprs as X
from adloom.functions.columns import BUCKETS, CATEGORICAL, NUMERIC, UNKNOWN
from adloom.operators.ranks import ranked
from adloom.operators.tables import insert_new


def unpivot(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature_name, feature_value): a row for each row and column, from one scan."""
    return df.unpivot(keep, columns, "feature_name", "feature_value")


def dim_event_day(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(event_day_key, event_batch, event_day_number, day_label). Keys number the natural keys in order, after those that exist."""
    seeds = staged.select("event_batch", "event_day_number").distinct()
    return _numbered(seeds, existing, ["event_batch", "event_day_number"], "event_day_key", {"day_label": F.concat(F.lit("training_day_"), F.col("event_day_number").cast("string"))})


def _numbered(seeds: DataFrame, existing: DataFrame | None, keys: list[str], name: str, more: dict) -> DataFrame:
    fresh = seeds if existing is None else insert_new(seeds, existing, keys)
    top = F.lit(0) if existing is None else F.lit(existing.agg(F.coalesce(F.max(name), F.lit(0))).first()[0])
    own = ranked(fresh, [], [F.col(k) for k in keys]).withColumn(name, F.col("rank0") + 1 + top)
    own = own.withColumns(more).select(name, *keys, *more)
    return own if existing is None else existing.unionByName(own)


def dim_numeric_bucket(spark: SparkSession) -> DataFrame:
    """The 91 seed rows: each numeric column with each bucket, numbered column by column."""
    rows = [(7 * i + b[2], c, *b) for i, c in enumerate(NUMERIC) for b in BUCKETS]
    return spark.createDataFrame(rows, T.StructType.fromDDL("numeric_bucket_key long, feature_name string, bucket_code string, bucket_label string, bucket_order int, lower_bound long, upper_bound long"))


def dim_categorical_value(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(categorical_value_key, feature_name, feature_value, is_unknown). The key is a hash of the natural key: values are too many to be
    numbered in order."""
    seeds = unpivot(staged, CATEGORICAL, []).distinct()
    fresh = seeds if existing is None else insert_new(seeds, existing, ["feature_name", "feature_value"])
    fresh = fresh.select(F.xxhash64("feature_name", "feature_value").alias("categorical_value_key"), "feature_name", "feature_value", (F.col("feature_value") == UNKNOWN).alias("is_unknown"))
    return fresh if existing is None else existing.unionByName(fresh)


FACT = ["raw_event_id", "batch_id", "event_day_key", "label", "click_flag", "impression_count", "click_count", "missing_numeric_count", "missing_categorical_count", "event_batch", "source_file", "ingested_at"]


def fact_ad_events(staged: DataFrame, days: DataFrame) -> DataFrame:
    """A fact for each staged row, with the key of its event day. The day dimension has seven rows a scale, so it is sent to all tasks."""
    return staged.join(F.broadcast(days.select("event_day_key", "event_batch", "event_day_number")), ["event_batch", "event_day_number"]).select(*FACT)


def bridge_numeric_bucket(staged: DataFrame, buckets: DataFrame) -> DataFrame:
    """(raw_event_id, batch_id, numeric_bucket_key, feature_name, feature_value): 13 rows an event. The dimension has 91 rows."""
    long = unpivot(staged, NUMERIC, ["raw_event_id", "batch_id"]).withColumn("bucket_code", X.bucket_code("feature_value"))
    return long.join(F.broadcast(buckets.select("feature_name", "bucket_code", "numeric_bucket_key")), ["feature_name", "bucket_code"]).select("raw_event_id", "batch_id", "numeric_bucket_key", "feature_name", "feature_value")


def bridge_categorical_value(staged: DataFrame, values: DataFrame) -> DataFrame:
    """(raw_event_id, batch_id, categorical_value_key, feature_name, feature_value): 26 rows an event. Spark picks the join: the dimension may
    be large."""
    long = unpivot(staged, CATEGORICAL, ["raw_event_id", "batch_id"])
    return long.join(values.select("feature_name", "feature_value", "categorical_value_key"), ["feature_name", "feature_value"]).select("raw_event_id", "batch_id", "categorical_value_key", "feature_name", "feature_value")


def event_day_summary(fact: DataFrame, days: DataFrame) -> DataFrame:
    return (
        fact.join(F.broadcast(days.select("event_day_key", "event_day_number", "day_label")), "event_day_key")
        .groupBy("event_batch", "event_day_number", "day_label")
        .agg(F.count(F.lit(1)).alias("impressions"), F.sum("click_count").alias("clicks"), X.ratio(F.sum("click_count"), F.sum("impression_count")).alias("ctr"), F.round(F.avg("missing_numeric_count"), 6).alias("avg_missing_numeric_count"), F.round(F.avg("missing_categorical_count"), 6).alias("avg_missing_categorical_count"))
    )


def data_quality_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("event_batch", "source_file").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.avg("missing_numeric_count"), 6).alias("avg_missing_numeric_count"),
        F.round(F.avg("missing_categorical_count"), 6).alias("avg_missing_categorical_count"),
        F.max("missing_numeric_count").alias("max_missing_numeric_count"),
        F.max("missing_categorical_count").alias("max_missing_categorical_count"),
    )
