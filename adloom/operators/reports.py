"""Reports on a layer: its measures in one row from one pass, and ordered listings of its first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import CATEGORICAL, NUMERIC


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count): a row for each table, empty ones too."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def listing(df: DataFrame, columns: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """The columns of df's rows in an order, the first n of them where n is given."""
    rows = df.orderBy(*order)
    return (rows.limit(n) if n else rows).select(*columns)


def by_day(df: DataFrame) -> DataFrame:
    """Rows, clicks and rate of each scale and event day."""
    return df.groupBy("event_batch", "event_day_number").agg(F.count(F.lit(1)).alias("row_count"), F.sum("click_count").alias("click_count"), X.ratio(F.sum("click_count"), F.sum("impression_count")).alias("ctr"))


def _broken(rules: dict[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]


MEASURES = {
    "invalid_impression_rows": lambda: F.col("impression_count") != 1,
    "invalid_click_flag_rows": lambda: ~F.col("click_flag").isin(0, 1),
    "invalid_click_count_rows": lambda: ~F.col("click_count").isin(0, 1),
}


def staging_validity(staged: DataFrame) -> DataFrame:
    """One row: how many rows break each rule, and lack each column that must be there, of all 48."""
    needed = ["raw_event_id", "label", "event_day_number", "event_batch", "source_file", "ingested_at", *NUMERIC, *CATEGORICAL]
    return staged.agg(*_broken({n: r() for n, r in MEASURES.items()} | {f"null_{c}_rows": F.col(c).isNull() for c in needed}))


def staging_missing(staged: DataFrame) -> DataFrame:
    """One row: the most and the mean of the counts of missing values."""
    return staged.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("max", F.max), ("avg", lambda c: F.round(F.avg(c), 6))) for c in ("missing_numeric_count", "missing_categorical_count")))


def fact_validity(fact: DataFrame) -> DataFrame:
    return fact.agg(*_broken({n: r() for n, r in MEASURES.items()}))


def store_validity(store: DataFrame) -> DataFrame:
    rules = {
        "invalid_label_rows": ~F.col("label").isin(0, 1),
        "null_raw_event_id_rows": F.col("raw_event_id").isNull(),
        "null_batch_id_rows": F.col("batch_id").isNull(),
        "invalid_overall_ctr_rows": (F.col("overall_ctr") < 0) | (F.col("overall_ctr") > 1),
        "invalid_event_day_rows": ~F.col("event_day_number").between(1, 7),
    }
    return store.agg(*_broken(rules))


def columns_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column, in order."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
