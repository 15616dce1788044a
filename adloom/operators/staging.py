"""From raw impressions to clean ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import CATEGORICAL, NUMERIC
from adloom.operators.ranks import tile_starts
from adloom.sources.work import saved

DAYS = 7
BROADCAST_FILES = 100_000


def with_event_day(raw: DataFrame, days: int = DAYS) -> DataFrame:
    """Adds event_day_number: the tile of the event within its source file, by event id. Only file and id are sorted; the few ids at which
    tiles begin are then compared with each row. They are a row a file: for up to BROADCAST_FILES files they are sent to all tasks, so
    wide rows aren't shuffled; beyond that rows and files are joined. Rows without a file form one group."""
    name = F.coalesce(F.col("source_file"), F.lit(""))
    starts = saved(tile_starts(raw.select(name.alias("_file"), "event_id"), ["_file"], "event_id", days), "starts")
    joined = raw.join(F.broadcast(starts) if starts.count() <= BROADCAST_FILES else starts, name == F.col("_file"), "left")
    tile = F.coalesce(F.size(F.filter("starts", lambda s: s <= F.col("event_id"))), F.lit(0)) + 1
    return joined.withColumn("event_day_number", tile.cast("int")).drop("_file", "starts")


def with_event_day_window(raw: DataFrame, days: int = DAYS) -> DataFrame:
    """The same by a window function, for files that one task can sort."""
    return raw.withColumn("event_day_number", F.ntile(days).over(Window.partitionBy("source_file").orderBy("event_id")))


def hash_event_day(columns: list[str], days: int = DAYS) -> Column:
    """An event day from a hash of all columns: needs no order and no shuffle."""
    return (F.pmod(F.xxhash64(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), F.lit(days)) + 1).cast("int")


def build(raw: DataFrame, day=with_event_day, trim: bool = False) -> DataFrame:
    """raw (event_id, batch_id, label, i1..i13, c1..c26, source_file, ingested_at). One clean row for each, with its event day, scale,
    measures and counts of missing values, which are taken before values are filled in."""
    dated = day(raw)
    label = X.clean_label("label")
    return dated.select(
        F.col("event_id").alias("raw_event_id"),
        "batch_id",
        label.alias("label"),
        *(X.fill_numeric(c).alias(c) for c in NUMERIC),
        *(X.fill_categorical(c, trim).alias(c) for c in CATEGORICAL),
        "event_day_number",
        X.event_batch("source_file").alias("event_batch"),
        label.alias("click_flag"),
        F.lit(1).alias("impression_count"),
        label.alias("click_count"),
        X.missing_numeric(NUMERIC).alias("missing_numeric_count"),
        X.missing_categorical(CATEGORICAL).alias("missing_categorical_count"),
        "source_file",
        "ingested_at",
    )


def hashed(raw: DataFrame) -> DataFrame:
    """The variant of the batch job: event day by hash, blank categories trimmed."""
    columns = ["label", *NUMERIC, *CATEGORICAL]
    return build(raw, lambda df: df.withColumn("event_day_number", hash_event_day(columns)), trim=True)


def batch_metrics(staged: DataFrame) -> DataFrame:
    """One row: rows, clicks, rate and mean counts of missing values."""
    return staged.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("click_count").alias("clicks"),
        F.round(F.avg("label"), 6).alias("ctr"),
        F.round(F.avg("missing_numeric_count"), 6).alias("avg_missing_numeric_count"),
        F.round(F.avg("missing_categorical_count"), 6).alias("avg_missing_categorical_count"),
    )


def _long(one_row: DataFrame, columns: list[str], keep: list[str], name: str, value: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns))
    return one_row.select(*keep, F.inline(pairs))


def missing_profile(raw: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_rate) of all 40 columns, from one pass over the rows."""
    columns = ["label", *NUMERIC, *CATEGORICAL]
    missing = lambda c: F.coalesce(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(True))
    counts = raw.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(c)).alias(c) for c in columns))
    return _long(counts, columns, ["n"], "column_name", "missing_count").select("column_name", "missing_count", X.ratio("missing_count", "n").alias("missing_rate"))


def unknown_profile(staged: DataFrame) -> DataFrame:
    """(column_name, unknown_rows, unknown_rate) of the categorical columns, from one pass."""
    counts = staged.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c) == "unknown").alias(c) for c in CATEGORICAL))
    return _long(counts, CATEGORICAL, ["n"], "column_name", "unknown_rows").select("column_name", "unknown_rows", X.ratio("unknown_rows", "n").alias("unknown_rate"))
