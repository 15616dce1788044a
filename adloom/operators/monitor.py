"""Model monitoring: metrics of runs, performance by score decile, drift of scores, comparison, dashboards, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.exprs import cents
from adloom.operators.tables import latest

MODEL = ["model_name", "model_version"]
METRICS = {"train": ["roc_auc", "pr_auc", "log_loss"], "validation": ["roc_auc", "pr_auc", "log_loss", "precision_at_10pct", "lift_at_10pct"], "test": ["roc_auc", "pr_auc", "log_loss", "precision_at_10pct", "lift_at_10pct"]}
CANONICAL = "canonical_1m_batch"
BASE_MODEL = "ctr_logistic_regression"


def _with_metrics(registry: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics and models. Runs and metrics both grow, and their files are small enough that Spark would send millions of rows to
    the driver and all tasks, so they are joined by a shuffle; the registry is cut to the models that have runs."""
    ran = registry.select("model_id", *MODEL).join(runs.select("model_id").distinct(), "model_id", "left_semi")
    return runs.join(metrics.hint("merge"), "training_run_id").join(ran, "model_id")


def latest_training_metrics(registry: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Of each model and split the metrics recorded last."""
    j = _with_metrics(registry, runs.select("model_id", "training_run_id", "run_status"), metrics)
    return latest(j, [*MODEL, "dataset_split"], [F.desc("recorded_at"), F.desc("metric_id")]).select(*MODEL, "training_run_id", "run_status", "dataset_split", "roc_auc", "pr_auc", "log_loss", "precision_at_10pct", "lift_at_10pct", "recorded_at")


IDS = ["batch_id", "model_id", "training_run_id", "model_name", "model_version"]


def decile_performance(scores: DataFrame, batches: DataFrame) -> DataFrame:
    """By batch, model and decile: rows, mean score, rate and their gap. Scores are summed before the batch's name is joined on."""
    mean = scores.groupBy(*IDS, "score_decile").agg(F.count(F.lit(1)).alias("rows_scored"), F.avg("predicted_ctr").alias("p"), F.avg("actual_click").alias("a"))
    return mean.join(batches.select("batch_id", "batch_name"), "batch_id").select(*IDS, "batch_name", "score_decile", "rows_scored", cents("p").alias("avg_predicted_ctr"), cents("a").alias("actual_ctr"), cents(F.col("p") - F.col("a")).alias("calibration_gap"))


def top_decile_performance(scores: DataFrame, batches: DataFrame) -> DataFrame:
    """By batch and model: all rows beside the top decile, in one pass over the scores."""
    top = F.col("is_top_decile")
    s = scores.groupBy(*IDS).agg(
        F.count(F.lit(1)).alias("rows_scored"), cents(F.avg("predicted_ctr")).alias("overall_avg_predicted_ctr"), cents(F.avg("actual_click")).alias("overall_actual_ctr"),
        F.count_if(top).alias("top_decile_rows"), F.coalesce(cents(F.avg(F.when(top, F.col("predicted_ctr")))), F.lit(0.0)).alias("top_decile_avg_predicted_ctr"), F.coalesce(cents(F.avg(F.when(top, F.col("actual_click")))), F.lit(0.0)).alias("top_decile_actual_ctr"),
    )
    s = s.join(batches.select("batch_id", "batch_name"), "batch_id")
    lift = F.when(F.col("overall_actual_ctr") != 0, cents(F.col("top_decile_actual_ctr") / F.col("overall_actual_ctr")))
    return s.withColumn("top_decile_lift_vs_batch_ctr", lift).withColumn("top_decile_predicted_ctr_gap", cents(F.col("top_decile_avg_predicted_ctr") - F.col("overall_avg_predicted_ctr"))).withColumn("top_decile_actual_ctr_gap", cents(F.col("top_decile_actual_ctr") - F.col("overall_actual_ctr")))


def score_drift(performance: DataFrame) -> DataFrame:
    """Each scored batch against the one before it of the same model."""
    w = Window.partitionBy(*MODEL).orderBy("batch_id")
    lags = {"batch_id": "previous_batch_id", "batch_name": "previous_batch_name", "overall_avg_predicted_ctr": "previous_avg_predicted_ctr", "overall_actual_ctr": "previous_actual_ctr", "top_decile_actual_ctr": "previous_top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr": "previous_top_decile_lift"}
    p = performance.drop("top_decile_predicted_ctr_gap", "top_decile_actual_ctr_gap").select("*", *(F.lag(c).over(w).alias(n) for c, n in lags.items()))
    change = lambda c, b: cents(F.col(c) - F.col(b))
    return p.select("*", change("overall_avg_predicted_ctr", "previous_avg_predicted_ctr").alias("avg_predicted_ctr_delta"), change("overall_actual_ctr", "previous_actual_ctr").alias("actual_ctr_delta"), change("top_decile_actual_ctr", "previous_top_decile_actual_ctr").alias("top_decile_actual_ctr_delta"), change("top_decile_lift_vs_batch_ctr", "previous_top_decile_lift").alias("top_decile_lift_delta"))


RUN = ["training_run_id", "train_batch_name", "rows_trained", "rows_validated", "rows_tested"]


def metric_pivot(registry: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row a run, with a column for each split and metric."""
    j = _with_metrics(registry, runs, metrics)
    of = lambda split, m: F.max(F.when(F.col("dataset_split") == split, F.col(m))).alias(f"{split}_{m}")
    return j.groupBy(*MODEL, *RUN).agg(*(of(split, m) for split, names in METRICS.items() for m in names))


def comparison(registry: DataFrame, runs: DataFrame, metrics: DataFrame, performance: DataFrame, canonical: str = CANONICAL) -> DataFrame:
    """Runs with their metrics, their scale, a note, and the batches that they scored."""
    p = metric_pivot(registry, runs, metrics)
    main = F.coalesce(F.col("train_batch_name") == canonical, F.lit(False))
    band = F.when(main | (F.col("rows_trained") >= 500_000), "large_scale").when(F.col("rows_trained") >= 100_000, "medium_scale").otherwise("small_scale")
    note = F.when(main & (F.col("model_name") == BASE_MODEL), "Canonical 1M logistic baseline.").when(F.col("rows_trained") < 1000, "Small-batch prototype; useful for experimentation, not the main benchmark claim.").otherwise("Experimental comparison run.")
    scored = performance.select(*MODEL, "training_run_id", F.col("batch_name").alias("scored_batch_name"), "rows_scored", "overall_actual_ctr", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr", "top_decile_avg_predicted_ctr")
    return p.withColumn("training_scale_band", band).withColumn("is_canonical_1m_run", main).withColumn("comparison_note", note).join(scored, [*MODEL, "training_run_id"], "left")


def active_canonical(registry: DataFrame, runs: DataFrame, compared: DataFrame) -> DataFrame:
    """The active model of each name, with its newest successful run."""
    newest = runs.where("run_status = 'SUCCESS'").groupBy("model_id").agg(F.max("training_run_id").alias("training_run_id"))
    active = registry.where("is_active_canonical").select("model_id", *MODEL, "canonical_promoted_at", "canonical_promotion_note").join(newest, "model_id", "left")
    columns = ["train_batch_name", "rows_trained", *(f"validation_{m}" for m in METRICS["validation"]), "test_roc_auc", "test_pr_auc", "test_log_loss", "top_decile_lift_vs_batch_ctr"]
    return active.withColumnRenamed("training_run_id", "_run").join(compared.withColumn("_run", F.col("training_run_id")).select(*MODEL, "_run", "training_run_id", *columns).hint("merge"), [*MODEL, "_run"], "left").drop("_run")


def _band(c: Column, *steps: tuple[float, str], other: str) -> Column:
    out = F.when(c >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(c >= least, name)
    return out.otherwise(other)


def latest_dashboard(compared: DataFrame, performance: DataFrame, drift: DataFrame, active: DataFrame, roc: float = 0.005, pr: float = 0.005, lift: float = 0.05) -> DataFrame:
    """A row a model: newest run and its newest scored batch, drift, distance from the active model, and bands."""
    by_run, by_batch = [F.desc_nulls_first("training_run_id"), F.desc_nulls_first("scored_batch_name")], [F.desc_nulls_first("batch_id")]
    run = latest(compared, MODEL, by_run).select(*MODEL, *RUN, "training_scale_band", "is_canonical_1m_run", "comparison_note", *(f"{s}_{m}" for s in ("validation", "test") for m in METRICS[s]))
    scored = latest(performance, MODEL, by_batch).select(*MODEL, "training_run_id", F.col("batch_id").alias("latest_scored_batch_id"), F.col("batch_name").alias("latest_scored_batch_name"), "rows_scored", "overall_avg_predicted_ctr", "overall_actual_ctr", "top_decile_rows", "top_decile_avg_predicted_ctr", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr", "top_decile_predicted_ctr_gap", "top_decile_actual_ctr_gap")
    moved = latest(drift, MODEL, by_batch).select(*MODEL, F.col("batch_id").alias("latest_scored_batch_id"), "previous_batch_id", "previous_batch_name", "avg_predicted_ctr_delta", "actual_ctr_delta", "top_decile_actual_ctr_delta", "top_decile_lift_delta")
    own = active.select(*MODEL, "training_run_id", F.lit(True).alias("_active"), "canonical_promotion_note")
    reference = active.select("model_name", *(F.col(f"validation_{m}").alias(f"active_validation_{m}") for m in ("roc_auc", "pr_auc", "lift_at_10pct")))
    j = run.join(own, [*MODEL, "training_run_id"], "left").join(scored, [*MODEL, "training_run_id"], "left").join(moved, [*MODEL, "latest_scored_batch_id"], "left").join(reference, "model_name", "left")
    gap = lambda m: cents(F.col(f"validation_{m}") - F.col(f"active_validation_{m}"))
    j = j.withColumn("is_active_canonical", F.coalesce("_active", F.lit(False))).withColumn("promotion_roc_auc_gap", gap("roc_auc")).withColumn("promotion_pr_auc_gap", gap("pr_auc")).withColumn("promotion_lift_gap", gap("lift_at_10pct"))
    better = (F.col("promotion_roc_auc_gap") >= roc) & (F.col("promotion_pr_auc_gap") >= pr) & (F.col("promotion_lift_gap") >= lift)
    status = F.when(F.col("is_active_canonical"), "active").when(F.col("active_validation_roc_auc").isNull(), "no_active_reference").when(better, "eligible").otherwise("not_eligible")
    top = F.coalesce("top_decile_lift_vs_batch_ctr", F.lit(0.0))
    moved_by = F.abs(F.coalesce("top_decile_lift_delta", F.lit(0.0)))
    j = j.withColumn("promotion_status", status).withColumn("validation_quality_band", _band(F.col("validation_roc_auc"), (0.70, "strong"), (0.60, "good"), (0.55, "watch"), other="weak"))
    return j.withColumn("ranking_quality_band", _band(top, (2.0, "strong"), (1.5, "good"), (1.2, "watch"), other="weak")).withColumn("drift_severity", _band(moved_by, (0.5, "high"), (0.2, "medium"), other="low")).drop("_active")


def active_dashboard(dashboard: DataFrame) -> DataFrame:
    return dashboard.where("is_active_canonical")


def batch_rankings(performance: DataFrame, compared: DataFrame) -> DataFrame:
    """Models ranked within each batch, by lift and by validation AUC; nulls come first."""
    run = compared.select(*MODEL, "training_run_id", "training_scale_band", "is_canonical_1m_run", "validation_roc_auc", "validation_pr_auc", "validation_precision_at_10pct", "validation_lift_at_10pct").distinct()
    j = performance.select(*IDS, "batch_name", "rows_scored", "overall_actual_ctr", "top_decile_rows", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr").join(run, [*MODEL, "training_run_id"], "left")
    lift, auc = F.desc_nulls_first("top_decile_lift_vs_batch_ctr"), F.desc_nulls_first("validation_roc_auc")
    rank = lambda *order: F.dense_rank().over(Window.partitionBy("batch_id").orderBy(*order))
    return j.withColumn("batch_rank_by_lift", rank(lift, auc)).withColumn("batch_rank_by_auc", rank(auc, lift))


def drift_watchlist(drift: DataFrame) -> DataFrame:
    lift, rate = F.abs(F.coalesce("top_decile_lift_delta", F.lit(0.0))), F.abs(F.coalesce("actual_ctr_delta", F.lit(0.0)))
    first = F.col("previous_batch_id").isNull()
    status = F.when(first, "baseline").when((lift >= 0.5) | (rate >= 0.05), "investigate").when((lift >= 0.2) | (rate >= 0.02), "watch").otherwise("stable")
    note = (
        F.when(first, "No previous scored batch for comparison.")
        .when(lift >= 0.5, "Top-decile lift changed materially from the previous batch.")
        .when(rate >= 0.05, "Observed batch CTR shifted materially from the previous batch.")
        .when(lift >= 0.2, "Top-decile lift moved enough to deserve review.")
        .when(rate >= 0.02, "Observed CTR moved enough to deserve review.")
        .otherwise("No material drift detected.")
    )
    columns = [*IDS, "batch_name", "previous_batch_id", "previous_batch_name", "overall_avg_predicted_ctr", "overall_actual_ctr", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr", "avg_predicted_ctr_delta", "actual_ctr_delta", "top_decile_actual_ctr_delta", "top_decile_lift_delta"]
    return drift.select(*columns, status.alias("drift_status"), note.alias("drift_note"))


def latest_importance(importance: DataFrame) -> DataFrame:
    """The importances of the newest run of each model."""
    newest = importance.groupBy(*MODEL).agg(F.max("training_run_id").alias("training_run_id"))
    return importance.join(newest, [*MODEL, "training_run_id"])


def group_importance(newest: DataFrame) -> DataFrame:
    at8 = lambda c: F.round(c, 8)
    v = F.col("abs_importance_value")
    return newest.groupBy(*MODEL, "training_run_id", "feature_group").agg(F.count(F.lit(1)).alias("features_in_group"), at8(F.sum(v)).alias("total_abs_importance"), at8(F.avg(v)).alias("avg_abs_importance"), at8(F.max(v)).alias("max_abs_importance"), cents(F.sum("relative_importance_pct")).alias("group_relative_importance_pct"))


def kpis(dashboard: DataFrame, watchlist: DataFrame, importance: DataFrame) -> DataFrame:
    """One row of measures over all models."""
    own = F.col("is_active_canonical")
    d = dashboard.agg(F.max("validation_roc_auc").alias("best_validation_roc_auc"), F.max("validation_pr_auc").alias("best_validation_pr_auc"), F.max("top_decile_lift_vs_batch_ctr").alias("best_top_decile_lift"), F.count_if("is_canonical_1m_run").alias("canonical_model_count"), F.max(F.when(own, F.col("validation_roc_auc"))).alias("active_validation_roc_auc"), F.max(F.when(own, F.col("validation_pr_auc"))).alias("active_validation_pr_auc"), F.max(F.when(own, F.col("top_decile_lift_vs_batch_ctr"))).alias("active_top_decile_lift"), F.count_if(F.col("promotion_status") == "eligible").alias("promotion_eligible_count"))
    w = watchlist.agg(F.count_if(F.col("drift_status") == "investigate").alias("investigate_drift_count"))
    return d.crossJoin(F.broadcast(w)).crossJoin(F.broadcast(importance.agg(cents(F.sum("relative_importance_pct")).alias("feature_relative_importance_pct"))))
