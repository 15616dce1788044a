"""Data-quality checks: one row of metrics a layer, turned into result rows, and reports over the results.

A layer's metrics are aggregates of its rows. They can be taken from a table that is there (`raw_checks` and its like), or while it is being
written (`Observer`), so that a run of all checks reads no layer again. Whether ids are unique takes a shuffle of the ids alone, of all layers at once.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import SPARSE
from adloom.operators.tables import latest
from adloom.sources.work import saved

COLUMNS = ["layer_name", "table_name", "check_name", "check_type", "severity", "check_status", "actual_value", "expected_value", "threshold_value", "check_message"]
RAW, STAGING, FACT, STORE = "raw.ad_events", "staging.stg_ad_events", "warehouse.fact_ad_events", "feature_store.ctr_training_features"


def _check(layer: str, table: str, name: str, kind: str, ok: Column, actual: Column, expected: Column | str, message: str) -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    status = F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    values = (F.lit(layer), F.lit(table), F.lit(name), F.lit(kind), F.lit("error"), status, text(actual), text(expected), F.lit(None).cast("string"), F.lit(message))
    return F.struct(*(v.alias(c) for v, c in zip(values, COLUMNS)))


def _rows(metrics: DataFrame, *checks: Column) -> DataFrame:
    return metrics.select(F.inline(F.array(*checks)))


def _duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _beside(*one_row: DataFrame) -> DataFrame:
    """Tables of one row side by side."""
    out = one_row[0]
    for x in one_row[1:]:
        out = out.crossJoin(F.broadcast(x))
    return out


def _none(c: str) -> Column:
    return F.col(c) == 0


def _rate(c: str) -> Column:
    return F.col(c).between(0, 1)


def duplicates(layers: dict[str, DataFrame], key: str = "raw_event_id") -> DataFrame:
    """One row: of each layer how many keys it has more than once. One shuffle of the keys of all layers."""
    both = None
    for name, df in layers.items():
        own = df.select(key, *(F.lit(int(name == n)).alias(n) for n in layers))
        both = own if both is None else both.unionByName(own)
    return both.groupBy(key).agg(*(F.sum(n).alias(n) for n in layers)).agg(*(F.count_if(F.col(n) > 1).alias(n) for n in layers))


class Observer:
    """Writes tables and keeps what was seen of their rows meanwhile."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, metrics: list[Column]) -> DataFrame:
        """df, whose metrics are known when it has been computed."""
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._seen[name], *metrics)

    def write(self, df: DataFrame, name: str, metrics: list[Column]) -> DataFrame:
        return saved(self.watch(df, name, metrics), name)

    def has(self, name: str) -> bool:
        return name in self._seen

    def row(self, spark: SparkSession, values: dict[str, tuple[str, str]]) -> DataFrame:
        """One row of metrics: column to (table, metric)."""
        return constants(spark, {c: self._seen[t].get[m] for c, (t, m) in values.items()})

    def of(self, spark: SparkSession, name: str) -> DataFrame:
        return constants(spark, self._seen[name].get)


def constants(spark: SparkSession, values: dict) -> DataFrame:
    """One row of values; one that isn't known counts as a double."""
    return spark.range(1).select(*((F.lit(v) if isinstance(v, (str, bool, int, float, date, datetime, list)) else F.lit(None if v is None else float(v)).cast("double")).alias(c) for c, v in values.items()))


def raw_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))).alias("labels"), F.count_if(F.col("source_file").isNull()).alias("files"), F.count_if(F.col("ingested_at").isNull()).alias("times")]


def raw_checks(raw: DataFrame) -> DataFrame:
    return raw_results(raw.agg(*raw_metrics()))


def raw_results(m: DataFrame) -> DataFrame:
    return _rows(
        m,
        _check("raw", RAW, "raw row count greater than zero", "row_count", F.col("n") > 0, F.col("n"), "> 0", "Raw layer should contain rows after ingestion."),
        _check("raw", RAW, "label must be 0 or 1", "validity", _none("labels"), F.col("labels"), "0 invalid rows", "All raw labels must be binary."),
        _check("raw", RAW, "source_file not null", "completeness", _none("files"), F.col("files"), "0 null rows", "source_file must be present on all raw rows."),
        _check("raw", RAW, "ingested_at not null", "freshness", _none("times"), F.col("times"), "0 null rows", "ingested_at must be present on all raw rows."),
    )


def staging_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in ("click_flag", "click_count")), F.count_if(F.col("impression_count") != 1).alias("impressions")]


def staging_checks(raw: DataFrame, staged: DataFrame) -> DataFrame:
    return staging_results(_beside(staged.agg(*staging_metrics()), _count(raw, "raw_n"), _duplicates(staged, "raw_event_id")))


def staging_results(m: DataFrame) -> DataFrame:
    """m: staging_metrics, raw_n, duplicate_groups."""
    return _rows(
        m,
        _check("staging", STAGING, "row count parity with raw", "consistency", F.col("n") == F.col("raw_n"), F.col("n"), F.col("raw_n"), "Staging row count should match raw row count."),
        _check("staging", STAGING, "raw_event_id uniqueness", "uniqueness", _none("duplicate_groups"), F.col("duplicate_groups"), "0 duplicate groups", "raw_event_id must uniquely identify staging rows."),
        _check("staging", STAGING, "click_flag binary validity", "validity", _none("click_flag"), F.col("click_flag"), "0 invalid rows", "click_flag must be 0 or 1."),
        _check("staging", STAGING, "click_count binary validity", "validity", _none("click_count"), F.col("click_count"), "0 invalid rows", "click_count must be 0 or 1."),
        _check("staging", STAGING, "impression_count must equal 1", "validity", _none("impressions"), F.col("impressions"), "0 invalid rows", "Every staging row should represent exactly one impression."),
    )


def thresholds(spark, values: dict[str, tuple[float, float]] = SPARSE) -> DataFrame:
    """(column_name, warning_threshold, error_threshold)."""
    return spark.createDataFrame([(c, *v) for c, v in values.items()], "column_name string, warning_threshold double, error_threshold double")


def sparsity_metrics() -> list[Column]:
    return [F.round(F.avg((F.col(c) == "unknown").cast("int")), 6).alias(c) for c in SPARSE]


def sparsity_checks(staged: DataFrame, limits: DataFrame) -> DataFrame:
    """The rate of `unknown` of each column with a threshold: PASS up to the warning, WARN up to the error threshold, else FAIL."""
    return sparsity_results(staged.agg(*sparsity_metrics()), limits)


def sparsity_results(rates: DataFrame, limits: DataFrame) -> DataFrame:
    columns = list(SPARSE)
    rates = rates.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rate")) for c in columns))))
    j = rates.join(F.broadcast(limits), "column_name")
    status = F.when(F.col("rate") <= F.col("warning_threshold"), "PASS").when(F.col("rate") <= F.col("error_threshold"), "WARN").otherwise("FAIL")
    text = lambda c: F.format_string("%.6f", c)
    values = (F.lit("staging"), F.lit(STAGING), F.concat("column_name", F.lit(" unknown rate threshold")), F.lit("completeness"), F.lit("warning"), status, text("rate"), F.concat(F.lit("<= "), text("warning_threshold")), text(F.coalesce("error_threshold", "warning_threshold")), F.lit("Configured unknown-rate threshold for sparse categorical columns."))
    return j.select(*(v.alias(c) for v, c in zip(values, COLUMNS)))


def fact_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_day_key").isNull()).alias("keys"), X.ratio(F.sum("click_count"), F.sum("impression_count")).alias("ctr")]


def warehouse_checks(staged: DataFrame, fact: DataFrame) -> DataFrame:
    return warehouse_results(_beside(fact.agg(*fact_metrics()), _count(staged, "staged_n"), _duplicates(fact, "raw_event_id")))


def warehouse_results(m: DataFrame) -> DataFrame:
    """m: fact_metrics, staged_n, duplicate_groups."""
    return _rows(
        m,
        _check("warehouse", FACT, "row count parity with staging", "consistency", F.col("n") == F.col("staged_n"), F.col("n"), F.col("staged_n"), "Warehouse fact row count should match staging row count."),
        _check("warehouse", FACT, "raw_event_id uniqueness", "uniqueness", _none("duplicate_groups"), F.col("duplicate_groups"), "0 duplicate groups", "raw_event_id must uniquely identify fact rows."),
        _check("warehouse", FACT, "event_day_key not null", "completeness", _none("keys"), F.col("keys"), "0 null rows", "Every fact row should map to an event-day dimension key."),
        _check("warehouse", FACT, "warehouse ctr between 0 and 1", "range", _rate("ctr"), F.format_string("%.6f", "ctr"), "0 to 1", "Warehouse CTR must stay within valid probability bounds."),
    )


def _populated(m: DataFrame, layer: str, table: str, name: str, tables: list[str], expected: str, message: str) -> DataFrame:
    said = F.concat(*(x for i, n in enumerate(tables) for x in (F.lit(f"{', ' * (i > 0)}{n}="), F.col(n).cast("string"))))
    ok = F.least(*tables) > 0 if len(tables) > 1 else F.col(tables[0]) > 0
    return _rows(m, _check(layer, table, name, "row_count", ok, said, expected, message))


def mart_metrics(name: str) -> list[Column]:
    """Of a mart or a ranked table."""
    more = {"overall": [F.max("ctr").alias("ctr")], "event_day": [F.max("ctr").alias("ctr")], "rolling": [F.min("rolling_3_day_weighted_ctr").alias("low"), F.max("rolling_3_day_weighted_ctr").alias("high")]}
    return [F.count(F.lit(1)).alias("n"), *more.get(name, [])]


def marts_checks(marts: dict[str, DataFrame]) -> DataFrame:
    """marts: overall, event_day, numeric, feature, missing, interaction."""
    counts = _beside(*(_count(df, n) for n, df in marts.items()))
    return marts_results(_beside(counts, marts["overall"].agg(F.max("ctr").alias("overall_ctr")), marts["event_day"].agg(F.max("ctr").alias("day_ctr"))), list(marts))


def marts_results(m: DataFrame, marts: list[str]) -> DataFrame:
    """m: the number of rows of each mart, overall_ctr, day_ctr."""
    rows = _populated(m, "marts", "marts layer", "mart row counts greater than zero", marts, "all mart row counts > 0", "All primary mart objects should be populated.")
    said = F.concat(F.lit("overall="), F.format_string("%.6f", "overall_ctr"), F.lit(", max_event_day="), F.format_string("%.6f", "day_ctr"))
    return rows.unionByName(_rows(m, _check("marts", "marts layer", "mart ctr values between 0 and 1", "range", _rate("overall_ctr") & _rate("day_ctr"), said, "0 to 1", "Mart CTR outputs must stay within valid probability bounds.")))


def advanced_checks(ranked: dict[str, DataFrame]) -> DataFrame:
    """ranked: feature_ranked, rolling, high_value, low_value, lift_ranked, interaction_ranked."""
    counts = _beside(*(_count(df, n) for n, df in ranked.items()))
    return advanced_results(_beside(counts, ranked["rolling"].agg(*mart_metrics("rolling")[1:])), list(ranked))


def advanced_results(m: DataFrame, ranked: list[str]) -> DataFrame:
    """m: the number of rows of each table, low and high of the rolling rate."""
    rows = _populated(m, "advanced_sql", "advanced sql layer", "advanced outputs populated", ranked, "all advanced outputs > 0", "All advanced SQL assets should be populated.")
    said = F.concat(F.lit("min="), F.format_string("%.6f", "low"), F.lit(", max="), F.format_string("%.6f", "high"))
    return rows.unionByName(_rows(m, _check("advanced_sql", "marts.event_day_ctr_rolling", "rolling ctr between 0 and 1", "range", _rate("low") & _rate("high"), said, "0 to 1", "Rolling CTR outputs must stay within valid probability bounds.")))


def store_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(~F.col("label").isin(0, 1)).alias("labels"), F.count_if(~F.col("event_day_number").between(1, 7)).alias("days")]


def feature_store_checks(fact: DataFrame, store: DataFrame) -> DataFrame:
    return store_results(_beside(store.agg(*store_metrics()), _count(fact, "fact_n"), _duplicates(store, "raw_event_id")))


def store_results(m: DataFrame) -> DataFrame:
    """m: store_metrics, fact_n, duplicate_groups."""
    return _rows(
        m,
        _check("feature_store", STORE, "feature store row count parity", "consistency", F.col("n") == F.col("fact_n"), F.col("n"), F.col("fact_n"), "Feature store rows should match warehouse fact rows."),
        _check("feature_store", STORE, "feature store labels valid", "validity", _none("labels"), F.col("labels"), "0 invalid rows", "Feature store labels must remain binary."),
        _check("feature_store", STORE, "feature store raw_event_id uniqueness", "uniqueness", _none("duplicate_groups"), F.col("duplicate_groups"), "0 duplicate groups", "Feature store should keep one row per raw event."),
        _check("feature_store", STORE, "feature store event_day_number validity", "validity", _none("days"), F.col("days"), "0 invalid rows", "Feature store event_day_number should stay within the 1 to 7 derived training window."),
    )


def observed_checks(seen: Observer, layers: dict[str, DataFrame], marts: list[str], ranked: list[str], limits: DataFrame) -> list[DataFrame]:
    """All checks from what `seen` has of raw, staging, fact, store, the marts and the ranked tables. layers: staging, fact and store as written, of which
    the ids are read."""
    spark = limits.sparkSession
    repeats = saved(duplicates(layers), "repeats")
    group = lambda name: repeats.select(F.col(name).alias("duplicate_groups"))
    counts = lambda names, **more: seen.row(spark, {n: (n, "n") for n in names} | more)
    return [
        raw_results(seen.of(spark, "raw")),
        staging_results(_beside(seen.of(spark, "staging"), seen.row(spark, {"raw_n": ("raw", "n")}), group("staging"))),
        sparsity_results(seen.of(spark, "staging"), limits),
        warehouse_results(_beside(seen.of(spark, "fact"), seen.row(spark, {"staged_n": ("staging", "n")}), group("fact"))),
        marts_results(counts(marts, overall_ctr=("overall", "ctr"), day_ctr=("event_day", "ctr")), marts),
        advanced_results(counts(ranked, low=("rolling", "low"), high=("rolling", "high")), ranked),
        store_results(_beside(seen.of(spark, "store"), seen.row(spark, {"fact_n": ("fact", "n")}), group("store"))),
    ]


def all_checks(parts: list[DataFrame], run_id: int, batch_id: int, raw: DataFrame) -> DataFrame:
    """The results of a run, tagged with it and with the names of the source files."""
    files = raw.agg(F.coalesce(F.array_join(F.array_sort(F.collect_set("source_file")), ", "), F.lit("unknown")).alias("source_file"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.crossJoin(F.broadcast(files)).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(batch_id).cast("long").alias("batch_id"), *COLUMNS, "source_file")


def latest_validation(results: DataFrame) -> DataFrame:
    """Of each check the newest result."""
    return latest(results, ["layer_name", "check_name"], [F.desc("checked_at"), F.desc("validation_id")])


def dashboard(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The newest run with counts of its results by status and severity. A run without results counts as one row of none."""
    newest = runs.agg(F.max("run_id").alias("run_id"))
    own = runs.join(F.broadcast(newest), "run_id", "left_semi")
    j = own.join(results.select("run_id", "check_status", "severity"), "run_id", "left")
    by = lambda c, v: F.count_if(F.col(c) == v)
    return j.groupBy("run_id", "pipeline_name", "run_status", "started_at", "completed_at").agg(
        F.count(F.lit(1)).alias("total_checks"), by("check_status", "PASS").alias("pass_checks"), by("check_status", "WARN").alias("warn_checks"), by("check_status", "FAIL").alias("fail_checks"), by("severity", "error").alias("error_severity_checks"), by("severity", "warning").alias("warning_severity_checks")
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("layer_name", "check_status").agg(F.count(F.lit(1)).alias("checks"))


def layer_report(df: DataFrame, keys: list[str], counters: dict[str, Column]) -> DataFrame:
    """Rows and counted conditions by key, from one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *(F.count_if(c).alias(n) for n, c in counters.items()))


def violations(scores: DataFrame) -> DataFrame:
    """One row: how many scores break each rule that a constrained table would enforce."""
    rules = scores.agg(F.count_if(~F.col("predicted_ctr").between(0, 1)).alias("predicted_out_of_range"), F.count_if(~F.col("score_decile").between(1, 10)).alias("decile_out_of_range"), F.count_if(~F.col("actual_click").isin(0, 1)).alias("click_not_binary"))
    repeats = scores.groupBy("raw_event_id", "model_id").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("repeated_rows"))
    return _beside(rules, repeats)
