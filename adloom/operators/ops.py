"""Pipeline operations: batch and run status, artifacts, benchmarks, health, and drift between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.operators.tables import latest

RUNTIME = "pipeline_stage_runtime"


def latest_batch_status(registry: DataFrame) -> DataFrame:
    return latest(registry, ["source_file", "sample_scale"], [F.desc("created_at"), F.desc("batch_id")])


def run_summary(runs: DataFrame, registry: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs of known batches with counts of their steps. Steps are counted before they are joined, so a run with many is one row."""
    by = lambda v: F.count_if(F.col("step_status") == v)
    counts = steps.groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias("total_steps"), by("SUCCESS").alias("successful_steps"), by("FAILED").alias("failed_steps"))
    own = runs.join(registry.select("batch_id", "batch_name"), "batch_id").join(counts, "pipeline_run_id", "left")
    return own.select("pipeline_run_id", "batch_id", "batch_name", "pipeline_name", "layer_name", "run_status", "started_at", "duration_seconds", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns[1:]))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    return latest(artifacts, ["batch_id", "artifact_name"], [F.desc("created_at"), F.desc("artifact_id")])


def benchmark_summary(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    newest = latest(snapshots, ["batch_id", "benchmark_name", "layer_name", "object_name"], [F.desc("recorded_at"), F.desc("benchmark_id")])
    return newest.join(registry.select("batch_id", "batch_name", "sample_scale"), "batch_id")


def health(registry: DataFrame, quality_runs: DataFrame, results: DataFrame, alerts: DataFrame, benchmarks: DataFrame, as_of: Column) -> DataFrame:
    """A row a batch: elapsed time, its newest quality run with counts, the alerts of its own run, and stage times."""
    newest = latest(quality_runs, ["batch_id"], [F.desc("started_at"), F.desc("run_id")])
    by = lambda c, v: F.count_if(F.col(c) == v)
    checks = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_quality_checks"), by("check_status", "PASS").alias("passed_quality_checks"), by("check_status", "WARN").alias("warning_quality_checks"), by("check_status", "FAIL").alias("failed_quality_checks"))
    quality = newest.join(checks, "run_id").select("batch_id", F.col("run_id").alias("latest_quality_run_id"), F.col("run_status").alias("latest_quality_run_status"), *checks.columns[1:])
    own = alerts.where("alert_run_id is not null").join(registry.select("batch_id", "orchestration_run_id"), "batch_id").where("alert_run_id = orchestration_run_id")
    counted = own.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_alerts"), by("alert_level", "error").alias("error_alerts"), by("alert_level", "warning").alias("warning_alerts"))
    times = benchmarks.where(F.col("benchmark_name") == RUNTIME).groupBy("batch_id").agg(F.sum("duration_seconds").alias("total"), F.max("duration_seconds").alias("slowest"))
    joined = registry.join(quality, "batch_id", "left").join(counted, "batch_id", "left").join(times, "batch_id", "left")
    zeros = [*checks.columns[1:], *counted.columns[1:]]
    return joined.select(
        *registry.columns,
        X.duration_s("created_at", "completed_at", as_of).alias("batch_elapsed_seconds"),
        "latest_quality_run_id",
        "latest_quality_run_status",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in zeros),
        F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total_stage_runtime_seconds"),
        F.round(F.coalesce("slowest", F.lit(0.0)), 3).alias("slowest_stage_runtime_seconds"),
    )


def runtime_trend(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.where(F.col("benchmark_name") == RUNTIME).select("batch_id", "batch_name", "sample_scale", "layer_name", "object_name", "duration_seconds", "rows_per_second", "row_count", "storage_mb", "recorded_at")


def scale_comparison(benchmarks: DataFrame, registry: DataFrame) -> DataFrame:
    """The benchmarks of the batch of each scale that was completed last."""
    newest = latest(registry.where(F.col("sample_scale").isin("100k", "1m", "5m")), ["sample_scale"], [F.desc_nulls_last("completed_at"), F.desc("batch_id")])
    own = benchmarks.drop("batch_name", "sample_scale").join(newest.select("batch_id", "batch_name", "sample_scale", "source_type", "completed_at"), "batch_id")
    return own.select("batch_id", "batch_name", "sample_scale", "source_type", "benchmark_name", "layer_name", "object_name", "row_count", *(F.round(c, 3).alias(c) for c in ("duration_seconds", "rows_per_second", "storage_mb")), "recorded_at", "completed_at")


def stage_benchmarks(summary: DataFrame, registry: DataFrame) -> DataFrame:
    """A snapshot for each successful run: rows of its batch and rows a second, null where no time passed."""
    own = summary.where("run_status = 'SUCCESS'").join(registry.select("batch_id", "expected_row_count"), "batch_id")
    speed = F.when((F.col("duration_seconds") > 0) & F.col("expected_row_count").isNotNull(), F.round(F.col("expected_row_count") / F.col("duration_seconds"), 3))
    return own.select("batch_id", "pipeline_run_id", F.lit(RUNTIME).alias("benchmark_name"), "layer_name", F.col("pipeline_name").alias("object_name"), F.col("expected_row_count").alias("row_count"), "duration_seconds", speed.alias("rows_per_second"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer_name, batch_id, row_count) of all layers that hold events."""
    out = None
    for name, df in layers.items():
        own = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("layer_name"), "batch_id", "row_count")
        out = own if out is None else out.unionByName(own)
    return out


def storage_rollup(benchmarks: DataFrame) -> DataFrame:
    """By batch: source and processed file sizes and the size of each layer's table."""
    size = F.col("storage_mb")
    where = lambda kind, layer: F.when((F.col("benchmark_name") == kind) & (F.col("layer_name") == layer), size)
    return benchmarks.groupBy("batch_id").agg(
        F.max(where("file_storage", "source")).alias("sample_file_size_mb"),
        F.round(F.sum(where("file_storage", "processed")), 3).alias("processed_artifact_size_mb"),
        *(F.max(where("table_storage", layer)).alias(f"{layer}_table_size_mb") for layer in ("raw", "staging", "warehouse", "feature_store")),
    )


def kpis(health_rows: DataFrame, trend: DataFrame) -> DataFrame:
    """One row of measures over all batches and stages."""
    h = health_rows.agg(
        F.sum("total_stage_runtime_seconds").alias("total_stage_runtime"), F.max("slowest_stage_runtime_seconds").alias("slowest_stage_runtime"), F.sum("total_quality_checks").alias("total_quality_checks"), F.sum("passed_quality_checks").alias("passed_quality_checks"), F.sum("failed_quality_checks").alias("failed_quality_checks"), F.sum("warning_quality_checks").alias("warning_quality_checks"), F.sum("total_alerts").alias("total_alerts"), F.sum("error_alerts").alias("error_alerts"), F.sum("warning_alerts").alias("warning_alerts"), F.max("batch_elapsed_seconds").alias("max_batch_elapsed_seconds"),
    )
    h = h.withColumn("quality_pass_rate", F.coalesce(X.ratio("passed_quality_checks", "total_quality_checks"), F.lit(0.0)))
    t = trend.agg(F.round(F.avg("duration_seconds"), 6).alias("avg_stage_runtime"), F.max("duration_seconds").alias("max_stage_runtime"), F.sum("row_count").alias("rows_processed"), F.round(F.avg("rows_per_second"), 6).alias("avg_rows_per_second"))
    return h.crossJoin(F.broadcast(t))


# --- drift ---


def metric_baseline(health_rows: DataFrame, fact: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """A row a batch: rows, clicks, rate and missing values of its facts beside health and storage."""
    n = F.count(F.lit(1))
    facts = fact.groupBy("batch_id").agg(n.alias("_rows"), F.sum("click_count").alias("_clicks"), X.ratio(F.sum("click_count"), n).alias("ctr"), F.round(F.avg("missing_numeric_count"), 6).alias("avg_missing_numeric_count"), F.round(F.avg("missing_categorical_count"), 6).alias("avg_missing_categorical_count"))
    joined = health_rows.join(facts, "batch_id", "left").join(storage_rollup(benchmarks), "batch_id", "left")
    return joined.withColumn("fact_rows", F.coalesce("_rows", F.lit(0))).withColumn("clicks", F.coalesce("_clicks", F.lit(0))).drop("_rows", "_clicks")


BEFORE = ["batch_id", "batch_name", "fact_rows", "ctr", "avg_missing_numeric_count", "avg_missing_categorical_count", "total_stage_runtime_seconds", "total_quality_checks", "failed_quality_checks", "total_alerts", "sample_file_size_mb"]


def drift_status() -> Column:
    """The first that holds, in this order."""
    old, new = (lambda c: F.col(f"previous_{c}")), F.col
    moved = lambda c, by: F.abs(new(c) - old(c)) >= by
    slower = (old("total_stage_runtime_seconds") > 0) & ((new("total_stage_runtime_seconds") - old("total_stage_runtime_seconds")) / old("total_stage_runtime_seconds") >= 0.5)
    return (
        F.when(old("batch_id").isNull(), "baseline")
        .when(new("failed_quality_checks") > F.coalesce(old("failed_quality_checks"), F.lit(0)), "quality_regression")
        .when(new("total_alerts") > F.coalesce(old("total_alerts"), F.lit(0)), "alert_regression")
        .when(moved("ctr", 0.05), "ctr_shift")
        .when(moved("avg_missing_categorical_count", 0.5), "missingness_shift")
        .when(slower, "runtime_regression")
        .otherwise("stable")
    )


def drift_summary(baseline: DataFrame) -> DataFrame:
    """Each batch against the one before it of its source type and scale. All lags share one window."""
    w = Window.partitionBy("source_type", "sample_scale").orderBy("batch_id")
    b = baseline.select("batch_id", "batch_name", "source_type", "sample_scale", *BEFORE[2:], *(F.lag(c).over(w).alias(f"previous_{c}") for c in BEFORE))
    d = lambda c, places=6: X.delta(c, f"previous_{c}", places)
    return b.select(
        "*",
        (F.col("fact_rows") - F.col("previous_fact_rows")).alias("fact_row_delta"),
        X.delta_ratio("fact_rows", "previous_fact_rows").alias("fact_row_delta_ratio"),
        d("ctr").alias("ctr_delta"),
        d("avg_missing_numeric_count").alias("avg_missing_numeric_delta"),
        d("avg_missing_categorical_count").alias("avg_missing_categorical_delta"),
        d("total_stage_runtime_seconds", 3).alias("runtime_delta_seconds"),
        X.delta_ratio("total_stage_runtime_seconds", "previous_total_stage_runtime_seconds").alias("runtime_delta_ratio"),
        (F.col("failed_quality_checks") - F.col("previous_failed_quality_checks")).alias("failed_quality_delta"),
        (F.col("total_alerts") - F.col("previous_total_alerts")).alias("alert_delta"),
        d("sample_file_size_mb", 3).alias("sample_file_size_delta_mb"),
        drift_status().alias("drift_status"),
    )


def stage_runtime_drift(trend: DataFrame, registry: DataFrame) -> DataFrame:
    own = trend.join(registry.select("batch_id", "source_type"), "batch_id")
    w = Window.partitionBy("source_type", "sample_scale", "layer_name", "object_name").orderBy("batch_id")
    own = own.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in ("batch_id", "batch_name", "duration_seconds", "rows_per_second")))
    return own.select("batch_id", "batch_name", "source_type", "sample_scale", "layer_name", "object_name", "row_count", "duration_seconds", "previous_batch_id", "previous_batch_name", "previous_duration_seconds", X.delta("duration_seconds", "previous_duration_seconds", 3).alias("duration_delta_seconds"), X.delta_ratio("duration_seconds", "previous_duration_seconds").alias("duration_delta_ratio"), "rows_per_second", "previous_rows_per_second", X.delta("rows_per_second", "previous_rows_per_second", 3).alias("rows_per_second_delta"), "recorded_at")
