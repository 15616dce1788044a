"""Keeping tables: replacing batches, inserting what is absent, newest-wins upserts, retention, logs folded into states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_batch(df: DataFrame, path: str, by: str = "batch_id") -> None:
    """Writes df's batches over the same batches at path and leaves the others: running it again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def insert_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys aren't in existing."""
    return df.join(existing.select(*keys), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the order. Spark cuts groups before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str, keep_old: list[str] | None = None) -> DataFrame:
    """existing with incoming's rows put in; of a key the newest version stays. Columns in keep_old that the newest row lacks are taken
    from the newest row that has them."""
    both = existing.unionByName(incoming)
    if not keep_old:
        return latest(both, keys, [F.col(version).desc_nulls_last()])
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*(c for c in rest if c not in keep_old)), F.col(version))
    older = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in keep_old]
    return both.groupBy(*keys).agg(newest.alias("_new"), *older).select(*keys, *(c if c in keep_old else F.col(f"_new.{c}") for c in rest))


def register_by_checksum(registry: DataFrame, incoming: DataFrame, seen_at: Column) -> DataFrame:
    """incoming (checksum, batch_name): known checksums get a new last_seen_at, unknown ones a row with status REGISTERED, one also where
    incoming repeats them (the least name)."""
    incoming = incoming.groupBy("checksum").agg(F.min("batch_name").alias("batch_name"))
    known = registry.join(incoming.select("checksum"), "checksum", "left_semi").withColumn("last_seen_at", seen_at)
    other = registry.join(incoming.select("checksum"), "checksum", "left_anti")
    fresh = incoming.join(registry.select("checksum"), "checksum", "left_anti").select("checksum", "batch_name", F.lit("REGISTERED").alias("batch_status"), seen_at.alias("last_seen_at"))
    columns = ["checksum", "batch_name", "batch_status", "last_seen_at"]
    return known.select(*columns).unionByName(other.select(*columns)).unionByName(fresh.select(*columns))


def keep_recent(df: DataFrame, at: str, as_of: Column, days: int = 90) -> DataFrame:
    """Drops rows recorded more than `days` days before as_of."""
    return df.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def latest_batch(raw: DataFrame) -> DataFrame:
    """The batch that was loaded last: (batch_id, source_file, row_count, latest_ingested_at), one row."""
    groups = raw.groupBy("batch_id", "source_file").agg(F.count(F.lit(1)).alias("row_count"), F.max("ingested_at").alias("latest_ingested_at"))
    return groups.orderBy(F.desc("latest_ingested_at"), F.desc("batch_id"), "source_file").limit(1)


def batch_by_name(registry: DataFrame, name: str) -> DataFrame:
    """The newest batch of a name, with defaults for what it lacks."""
    own = registry.where(F.col("batch_name") == name).orderBy(F.desc("batch_id")).limit(1)
    return own.select("batch_id", "batch_name", F.coalesce("source_type", F.lit("sample")).alias("source_type"), F.coalesce("sample_scale", F.lit("unknown")).alias("sample_scale"), F.coalesce("expected_row_count", F.lit(0)).alias("expected_row_count"))


def sample_scale(name: Column) -> Column:
    """The scale that a file name tells, `incoming` where it tells none."""
    lower = F.lower(name)
    return F.when(lower.contains("100k"), "100k").when(lower.contains("1m"), "1m").when(lower.contains("5m"), "5m").otherwise("incoming")


def batch_name(file_name: Column, checksum: Column) -> Column:
    """The file's stem in lower case with underscores, and the first 12 characters of its checksum."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.concat_ws("_", F.translate(F.lower(stem), " -", "__"), F.substring(checksum, 1, 12))


def content_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, row_count, digest): a digest of each source's rows that doesn't depend on their order. Nulls count, and so does where they are."""
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]  # hash functions pass over nulls
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *(F.sum(F.xxhash64(F.lit(i), *cells).cast("decimal(38,0)")).alias(n) for i, n in enumerate("ab")))
    return sums.select(*by, "row_count", F.sha2(F.concat_ws("|", "row_count", "a", "b"), 256).alias("digest"))


def run_states(log: DataFrame) -> DataFrame:
    """log (pipeline_run_id, seq, run_status, run_message, row_count, at): the current state of each run, folded from its events."""
    return log.groupBy("pipeline_run_id").agg(F.max_by("run_status", "seq").alias("run_status"), F.max_by("run_message", "seq").alias("run_message"), F.max_by("row_count", F.when(F.col("row_count").isNotNull(), F.col("seq"))).alias("row_count"), F.min("at").alias("started_at"), F.max(F.when(F.col("run_status") != "RUNNING", F.col("at"))).alias("completed_at"))


def batch_states(log: DataFrame) -> DataFrame:
    """log (batch_id, seq, batch_status, stage, row_count, at): newest status and stage, first start, last end, last known count."""
    return log.groupBy("batch_id").agg(F.max_by("batch_status", "seq").alias("batch_status"), F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("seq"))).alias("last_successful_stage"), F.max_by("row_count", F.when(F.col("row_count").isNotNull(), F.col("seq"))).alias("actual_row_count"), F.min("at").alias("started_at"), F.max(F.when(F.col("batch_status") == "COMPLETED", F.col("at"))).alias("completed_at"))
