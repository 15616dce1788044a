"""Impressions and operational tables derived from the driver's tables, by arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import CATEGORICAL, NUMERIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the events that one task has, about.
TASK_ROWS = 250_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt out to all cores and to more tasks the more rows there are. Files can't tell: one row group is one task's, whatever its size
    and however many parts its file is cut into."""
    e = table(spark, sf_dir, "events")
    return e.repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // TASK_ROWS)), "event_id", "ts", "user_id")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ad impressions from `events`: event_id, batch_id, label, i1..i13, c1..c26, source_file, ingested_at."""
    # Columns of their own: within the conditions below they would be computed once a value, the hour 26 times.
    e = events(spark, sf_dir).withColumns({"hour": F.hour("ts"), "batch_id": (F.floor((F.dayofmonth("ts") - 1) / 10.0) + 1).cast("long")})
    hour, batch = F.col("hour"), F.col("batch_id")
    event, user = F.col("event_id"), F.col("user_id")
    numbers = [
        F.when(event % 10 != 0, F.floor("value")).cast("int").alias("i1"),
        F.when(user % 7 != 0, user - 20).cast("int").alias("i2"),
        F.get_json_object("props", "$.k").cast("int").alias("i3"),
    ]
    for j in range(4, 14):
        numbers.append(F.when(event % (j + 3) != 0, (event * j + user) % (5 * 10 ** (j % 5)) - j % 3).cast("int").alias(f"i{j}"))
    values = []
    for j in range(1, 27):
        if j == 22:
            value = F.when(user % 9 != 0, F.concat(F.lit("g"), (user % 4).cast("string")))
        else:
            value = F.when((event + j) % (j % 9 + 3) == 0, "").when((event + j) % (j % 9 + 17) != 0, F.concat(F.lit("v"), ((user * j + hour) % (3 * j + 2)).cast("string")))
        values.append(value.alias(f"c{j}"))
    name = F.when(batch == 1, "events_100k.csv").when(batch == 2, "events_1m.csv").otherwise(F.concat(F.lit("events_live_"), batch.cast("string"), F.lit(".csv")))
    label = F.when((F.col("event_type") == "click") | ((F.col("event_type") == "purchase") & (user % 4 == 0)), 1).otherwise(0)
    return e.select("event_id", "batch_id", label.alias("label"), *numbers, *values, name.alias("source_file"), F.col("ts").alias("ingested_at"))


assert len(NUMERIC) == 13 and len(CATEGORICAL) == 26


def batch_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts").cast("long")
    g = table(spark, sf_dir, "events").groupBy(day.alias("batch_id")).agg(F.count(F.lit(1)).alias("expected_row_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last"))
    b = F.col("batch_id")
    text = lambda c: c.cast("string")
    return g.select(
        "batch_id",
        F.concat(F.lit("batch_"), text(b)).alias("batch_name"),
        F.concat(F.lit("events_"), text(b % 5), F.lit(".csv")).alias("source_file"),
        F.when(b % 2 == 0, "incoming").otherwise("sample").alias("source_type"),
        F.when(b % 3 == 0, "100k").when(b % 3 == 1, "1m").otherwise("5m").alias("sample_scale"),
        F.when(b % 7 == 0, "RUNNING").otherwise("COMPLETED").alias("batch_status"),
        "expected_row_count",
        "created_at",
        F.when(b % 7 != 0, F.col("last")).alias("completed_at"),
        F.concat(F.lit("run_"), text(b)).alias("orchestration_run_id"),
    )


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    layers = F.array(*(F.lit(x) for x in ("raw", "staging", "warehouse", "marts", "feature_store")))
    status = F.when(F.col("o_orderstatus") == "O", "SUCCESS").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("RUNNING")
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("pipeline_run_id"),
        (F.col("o_custkey") % 30 + 1).cast("long").alias("batch_id"),
        F.element_at(layers, (key % 5 + 1).cast("int")).alias("layer_name"),
        F.col("o_orderpriority").alias("pipeline_name"),
        status.alias("run_status"),
        F.col("o_orderdate").cast("date").alias("started_at"),
        F.when(F.col("o_orderstatus") != "P", (key % 900).cast("double")).alias("duration_seconds"),
    )


def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("pipeline_run_id"), F.when(flag == "R", "SUCCESS").when(flag == "A", "FAILED").otherwise("RUNNING").alias("step_status"))


def benchmark_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("benchmark_id"),
        (F.col("o_custkey") % 30 + 1).cast("long").alias("batch_id"),
        pick(3, "pipeline_stage_runtime", "table_storage", "file_storage").alias("benchmark_name"),
        F.when(key % 3 == 2, F.when(F.floor(key / 3) % 2 == 0, "source").otherwise("processed")).otherwise(F.element_at(F.array(*(F.lit(x) for x in ("raw", "staging", "warehouse", "marts", "feature_store"))), (F.floor(key / 3) % 5 + 1).cast("int"))).alias("layer_name"),
        F.concat(F.lit("object_"), (F.floor(key / 15) % 2).cast("string")).alias("object_name"),
        (key % 5000).cast("long").alias("row_count"),
        (key % 900).cast("double").alias("duration_seconds"),
        F.when(key % 900 > 0, F.round((key % 5000) / (key % 900), 3)).alias("rows_per_second"),
        F.round(F.col("o_totalprice").cast("double") / 1000, 3).alias("storage_mb"),
        F.col("o_orderdate").cast("date").alias("recorded_at"),
    )


def validation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("validation_id"),
        F.dayofmonth("ts").cast("long").alias("run_id"),
        F.concat(F.lit("layer_"), (user % 5).cast("string")).alias("layer_name"),
        F.concat(F.lit("chk_"), (F.col("event_id") % 26).cast("string")).alias("check_name"),
        F.when(kind == "error", "FAIL").when(kind == "signup", "WARN").otherwise("PASS").alias("check_status"),
        F.when(user % 2 == 0, "error").otherwise("warning").alias("severity"),
        F.col("ts").alias("checked_at"),
    )


def validation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a day; each checks the batch of that day."""
    day = F.dayofmonth("ts").cast("long")
    return table(spark, sf_dir, "events").groupBy(day.alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at")).select("run_id", F.col("run_id").alias("batch_id"), F.lit("quality").alias("pipeline_name"), F.when(F.col("run_id") % 4 == 0, "FAILED").otherwise("SUCCESS").alias("run_status"), "started_at", "completed_at")


def pipeline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, user = F.dayofmonth("ts").cast("long"), F.col("user_id")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), day.alias("batch_id"), F.when(user % 2 == 0, "error").otherwise("warning").alias("alert_level"), F.when(user % 3 != 0, F.concat(F.lit("run_"), day.cast("string"))).alias("alert_run_id"))


def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three models for each event; many are tied."""
    click = (F.col("event_type") == "click").cast("int")
    model = F.explode(F.sequence(F.lit(1), F.lit(3)))
    s = events(spark, sf_dir).select(F.col("event_id").alias("raw_event_id"), F.dayofmonth("ts").cast("long").alias("batch_id"), "user_id", click.alias("actual_click"), model.alias("m"))
    score = F.lit(0.05) + F.lit(0.3) * F.col("actual_click") + ((F.col("raw_event_id") * 37 + F.col("user_id") * 11 * F.col("m")) % 1000) / F.lit(2000.0)
    return s.select("raw_event_id", "batch_id", F.col("m").cast("long").alias("model_id"), F.concat(F.lit("v"), F.col("m").cast("string")).alias("model_version"), "actual_click", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("predicted_ctr"))


# --- models: registry from suppliers, runs and metrics from orders, coefficients from parts ---


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "supplier").select(
        key.alias("model_id"),
        F.when(key % 4 == 0, "ctr_logistic_regression").otherwise(F.concat(F.lit("model_"), text(key % 4))).alias("model_name"),
        F.concat(F.lit("v"), text(key)).alias("model_version"),
        F.when(key % 5 == 4, "TRAINING").otherwise("READY").alias("model_status"),
        (key < 4).alias("is_active_canonical"),
        F.when(key < 4, F.lit("2024-01-01").cast("date")).alias("canonical_promoted_at"),
        F.when(key < 4, F.concat(F.lit("note "), text(key))).alias("canonical_promotion_note"),
    )


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        key.alias("training_run_id"),
        (F.col("o_custkey") % 10).alias("model_id"),
        F.when(done == "F", "FAILED").otherwise("SUCCESS").alias("run_status"),
        F.when(key % 17 == 0, "canonical_1m_batch").otherwise(F.concat(F.lit("batch_"), (F.col("o_custkey") % 30 + 1).cast("string"))).alias("train_batch_name"),
        (key * 37 % 900_000).alias("rows_trained"),
        (key * 7 % 90_000).alias("rows_validated"),
        (key * 5 % 90_000).alias("rows_tested"),
        F.when(done != "P", F.col("o_orderdate").cast("date")).alias("completed_at"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows a run; the validation AUC is missing for some."""
    key, k = F.col("o_orderkey"), F.col("k")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    split = F.element_at(F.array(*(F.lit(x) for x in ("train", "validation", "test"))), k + 1)
    return o.select(
        (key * 3 + k).alias("metric_id"),
        key.alias("training_run_id"),
        split.alias("dataset_split"),
        F.when((k != 1) | (key % 23 != 0), 0.5 + (key * (k + 7) % 4000) / F.lit(10000.0)).alias("roc_auc"),
        (0.2 + (key * (k + 11) % 5000) / F.lit(10000.0)).alias("pr_auc"),
        (0.3 + (key * (k + 13) % 6000) / F.lit(10000.0)).alias("log_loss"),
        (0.1 + (key * (k + 17) % 7000) / F.lit(10000.0)).alias("precision_at_10pct"),
        (1.0 + (key * (k + 19) % 2000) / F.lit(1000.0)).alias("lift_at_10pct"),
        F.col("o_orderdate").cast("date").alias("recorded_at"),
    )


def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the names of their models and each model's newest successful run."""
    newest = training_runs(spark, sf_dir).where("run_status = 'SUCCESS'").groupBy("model_id").agg(F.max("training_run_id").alias("training_run_id"))
    models = model_registry(spark, sf_dir).select("model_id", "model_name", "model_version")
    return prediction_scores(spark, sf_dir).drop("model_version").join(models, "model_id").join(newest, "model_id")


#: Names of features that coefficients are given to, one for each rule of classification.
FEATURES = ["missing_ratio", "overall_ctr", "i1_log_scale", "i7", "i3_bucket_code_enc_ctr", "bucket_lift_mean", "c1_ctr_lift", "c6_feature_impressions_log1p", "c19_enc_ctr", "a_x_b", "numeric_log_sum", "categorical_lift_sum", "total_count", "other_thing", "event_day_x_bucket_lift_mean"]


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, training_run_id, feature_name, importance_value) of four models with two runs each."""
    key = F.col("p_partkey")
    names = F.array(*(F.lit(x) for x in FEATURES))
    return table(spark, sf_dir, "part").select((key % 4).alias("model_id"), (F.floor(key / 4) % 2).alias("training_run_id"), F.concat(F.element_at(names, (F.floor(key / 8) % len(FEATURES) + 1).cast("int")), F.when(F.floor(key / 8) >= len(FEATURES), F.concat(F.lit("_"), F.floor(key / 8).cast("string"))).otherwise("")).alias("feature_name"), F.round((key * 7919 % 2001 - 1000) / 1000.0, 6).alias("importance_value"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("artifact_id"), (F.col("o_custkey") % 30 + 1).alias("batch_id"), F.concat(F.lit("artifact_"), (key % 4).cast("string")).alias("artifact_name"), (key % 5000).alias("row_count"), F.col("o_orderdate").cast("date").alias("created_at"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start event for each order, and an end event for those that ended."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    start = o.select(key.alias("pipeline_run_id"), F.lit(0).cast("long").alias("seq"), F.lit("RUNNING").alias("run_status"), F.lit("started").alias("run_message"), (key % 500).alias("row_count"), F.col("o_orderdate").cast("date").alias("at"))
    end = o.where("o_orderstatus != 'P'").select(key.alias("pipeline_run_id"), F.lit(1).cast("long").alias("seq"), F.when(F.col("o_orderstatus") == "O", "SUCCESS").otherwise("FAILED").alias("run_status"), F.concat(F.lit("ended "), "o_orderpriority").alias("run_message"), F.when(key % 3 != 0, key % 1000).alias("row_count"), F.date_add(F.col("o_orderdate").cast("date"), 1).alias("at"))
    return start.unionByName(end)


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of batches; the order's key is their sequence."""
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30 + 1).alias("batch_id"), key.alias("seq"), F.when(status == "O", "COMPLETED").when(status == "F", "FAILED").otherwise("RUNNING").alias("batch_status"), F.when(status == "O", F.concat(F.lit("stage_"), (key % 5).cast("string"))).alias("stage"), F.when(key % 3 != 0, key % 1000).alias("row_count"), F.col("o_orderdate").cast("date").alias("at"))
