"""Queries of single operators that the marts, views and models of queries.py are made of, each with the SQL for it alone, and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import CATEGORICAL, NUMERIC, STORED
from adloom.operators import evaluate, features, importance, marts, monitor, ops, promote, quality, ranked, reports, sampling, tables, train, warehouse
from adloom.plans import oracle as O
from adloom.plans import queries
from adloom.plans.queries import HIGH, LOOKUP, MEDIUM, MEDIUM_BUCKET, SAMPLES, SIZES, STORE_KEYS, Frames, J, _decided, add
from adloom.sources import binding
from adloom.sources.work import saved

# --- projections ---
add("p7_measures", lambda f: f.stg.select("raw_event_id", "click_flag", "impression_count", "click_count"), "SELECT event_id AS raw_event_id, label AS click_flag, 1 AS impression_count, label AS click_count FROM imp")
FLAGS = ["has_missing_numeric", "has_missing_categorical", "high_missingness_flag"]
add("p12_missing_flags", lambda f: f.stg.select("raw_event_id", *features.missing_flags()), f"SELECT event_id AS raw_event_id, CAST({O.MISSING_N} > 0 AS INT) AS has_missing_numeric, CAST({O.MISSING_C} > 0 AS INT) AS has_missing_categorical, CAST({O.MISSING_N} + {O.MISSING_C} >= 5 AS INT) AS high_missingness_flag FROM imp")
VALUE = ["batch_id", "feature_name", "feature_value"]
add("p13_volume_band", lambda f: f.b_feature.select(*VALUE, X.volume_band("impressions", HIGH, MEDIUM).alias("band"), X.volume_band("impressions", HIGH, MEDIUM_BUCKET).alias("bucket_band")), f"SELECT {J(VALUE)}, {O.band('impressions', HIGH, MEDIUM)} AS band, {O.band('impressions', HIGH, MEDIUM_BUCKET)} AS bucket_band FROM b_feature")
add("p14_lift", lambda f: f.b_feature.crossJoin(F.broadcast(f.m_overall.select(F.col("ctr").alias("overall")))).select(*VALUE, X.lift("ctr", "overall").alias("lift")), f"SELECT {J(VALUE)}, round(ctr - (SELECT ctr FROM m_overall), 6) AS lift FROM b_feature")
add("p15_safe_ratio", lambda f: f.of(binding.training_runs).select("training_run_id", X.ratio(F.col("rows_trained"), F.col("rows_validated") % 5).alias("ratio")), "SELECT training_run_id, round(CAST(rows_trained AS DOUBLE) / nullif(rows_validated % 5, 0), 6) AS ratio FROM truns")
add("p16_fixed_precision", lambda f: f.of(binding.training_runs).select("training_run_id", X.fixed(F.col("rows_trained") / F.lit(7.0), 12, 6).cast("double").alias("fixed")), "SELECT training_run_id, CAST(CAST(rows_trained / 7e0 AS DECIMAL(12, 6)) AS DOUBLE) AS fixed FROM truns")
add("p17_strings", lambda f: f.imp.select("event_id", F.concat(F.col("c22"), F.lit(" x "), F.col("c19")).alias("pair"), F.concat(F.lit("training_day_"), F.col("label").cast("string")).alias("day_label")), "SELECT event_id, c22 || ' x ' || c19 AS pair, 'training_day_' || CAST(label AS VARCHAR) AS day_label FROM imp")
add("p18_unknown_flag", lambda f: warehouse.unpivot(f.stg, CATEGORICAL, ["raw_event_id"]).select("raw_event_id", "feature_name", X.is_unknown("feature_value").alias("is_unknown")), "SELECT raw_event_id, feature_name, feature_value = 'unknown' AS is_unknown FROM long_c")
add("p20_delta_ratio", lambda f: f.of(binding.training_runs).select("training_run_id", X.delta_ratio(F.col("rows_trained"), F.nullif(F.col("rows_tested") % 4, F.lit(3))).alias("delta_ratio")), f"SELECT training_run_id, {O.delta_ratio('rows_trained', 'base')} AS delta_ratio FROM (SELECT *, nullif(rows_tested % 4, 3) AS base FROM truns)")

# --- joins ---
add("j1_staging_event_day", lambda f: f.fact.select("raw_event_id", "event_day_key"), "SELECT raw_event_id, event_day_key FROM stg JOIN dday USING (event_batch, event_day_number)")
add("j2_fact_day_dimension", lambda f: f.fact.join(F.broadcast(f.days.select("event_day_key", "day_label")), "event_day_key").select("raw_event_id", "day_label"), "SELECT raw_event_id, concat('training_day_', CAST(event_day_number AS VARCHAR)) AS day_label FROM stg")
add("j3_values_bucket_dimension", lambda f: warehouse.bridge_numeric_bucket(f.stg, warehouse.dim_numeric_bucket(f.spark)).join(F.broadcast(warehouse.dim_numeric_bucket(f.spark).select("numeric_bucket_key", "bucket_label", "bucket_order")), "numeric_bucket_key").select("raw_event_id", "feature_name", "bucket_label", "bucket_order"), f"SELECT raw_event_id, feature_name, {O._label('bucket_code')} AS bucket_label, {O._order('bucket_code')} AS bucket_order FROM long_n")
add("j4_scalar_cross_join", lambda f: marts._against(f.b_day, f.m_overall).select("batch_id", "event_day_number", "event_batch", "overall_ctr", "ctr_lift_vs_overall"), f"SELECT batch_id, event_day_number, event_batch, {O.LIFT} FROM b_day")
LOOKED = [f"{c}_bucket_ctr_lift" for c in NUMERIC] + [f"{c}{x}" for c in STORED for x in ("_ctr_lift", "_feature_impressions")]
add("j5_lookup_joins", lambda f: f.store.select("raw_event_id", *LOOKED), f"SELECT raw_event_id, {J(LOOKED)} FROM store")
HEALTH = ["batch_id", "latest_quality_run_id", "total_quality_checks", "failed_quality_checks", "total_alerts", "total_stage_runtime_seconds"]
add("j6_batch_star", lambda f: f.health.select(*HEALTH), f"SELECT {J(HEALTH)} FROM health")
add("j7_runs_with_steps", lambda f: f.runsum.select("pipeline_run_id", "total_steps"), "SELECT r.pipeline_run_id, count(s.step_status) AS total_steps FROM runs r JOIN reg b USING (batch_id) LEFT JOIN steps s USING (pipeline_run_id) GROUP BY 1")
RATES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CAST({c} = 'unknown' AS INT)) AS rate FROM stg" for c in ("c22", "c19", "c20", "c25", "c26"))
add("j8_thresholds", lambda f: quality.sparsity_checks(f.stg, quality.thresholds(f.spark)).select("check_name", "check_status"), f"SELECT column_name || ' unknown rate threshold' AS check_name, CASE WHEN round(rate, 6) <= w THEN 'PASS' WHEN round(rate, 6) <= e THEN 'WARN' ELSE 'FAIL' END AS check_status FROM ({RATES}) JOIN (VALUES ('c22', 0.80e0, 0.90e0), ('c19', 0.50e0, 0.65e0), ('c20', 0.50e0, 0.65e0), ('c25', 0.50e0, 0.65e0), ('c26', 0.50e0, 0.65e0)) l(column_name, w, e) USING (column_name)")


def _new_values(f: Frames):
    known = warehouse.dim_categorical_value(f.stg.where("batch_id = 1"))
    return tables.insert_new(warehouse.dim_categorical_value(f.stg), known, ["feature_name", "feature_value"]).select("feature_name", "feature_value")


add("j9_left_anti", _new_values, "SELECT DISTINCT feature_name, feature_value FROM long_c EXCEPT SELECT feature_name, feature_value FROM long_c WHERE batch_id = 1")
add("j10_newest_run_of_each", lambda f: f.active.select("model_id", "training_run_id").distinct(), "SELECT DISTINCT m.model_id, t.training_run_id FROM models m LEFT JOIN (SELECT model_id, max(training_run_id) AS run FROM truns WHERE run_status = 'SUCCESS' GROUP BY 1) n USING (model_id) LEFT JOIN (SELECT DISTINCT model_name, model_version, training_run_id FROM mcomp) t ON t.model_name = m.model_name AND t.model_version = m.model_version AND t.training_run_id = n.run WHERE m.is_active_canonical")
add("j13_registry_runs_metrics", lambda f: f.models.join(f.truns, "model_id").join(f.tmetrics, "training_run_id").select("model_name", "model_version", "training_run_id", "dataset_split", "roc_auc"), "SELECT model_name, model_version, training_run_id, dataset_split, roc_auc FROM models JOIN truns USING (model_id) JOIN tmetrics USING (training_run_id)")
add("j14_runs_scored_batches", lambda f: f.mcomp.select("model_name", "model_version", "training_run_id", "scored_batch_name", "rows_scored"), "SELECT p.model_name, p.model_version, p.training_run_id, s.batch_name AS scored_batch_name, s.rows_scored FROM mpivot p LEFT JOIN perf s USING (model_name, model_version, training_run_id)")
add("j15_newest_key_set", lambda f: f.limp.select("model_name", "model_version", "training_run_id", "feature_name"), "SELECT model_name, model_version, training_run_id, feature_name FROM limp")
add("j16_alerts_of_own_run", lambda f: f.health.select("batch_id", "total_alerts", "error_alerts", "warning_alerts"), "SELECT r.batch_id, count(a.alert_id) AS total_alerts, count(*) FILTER (WHERE alert_level = 'error') AS error_alerts, count(*) FILTER (WHERE alert_level = 'warning') AS warning_alerts FROM reg r LEFT JOIN alerts a ON a.batch_id = r.batch_id AND a.alert_run_id = r.orchestration_run_id GROUP BY 1")

# --- aggregations ---
add("a9_weighted_means", lambda f: f.m_overall.select("impressions", "avg_missing_numeric_count", "avg_missing_categorical_count"), "SELECT CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(avg_missing_numeric_count * impressions) / sum(impressions), 6) AS avg_missing_numeric_count, round(sum(avg_missing_categorical_count * impressions) / sum(impressions), 6) AS avg_missing_categorical_count FROM b_overall")
add("a10_any_unknown", lambda f: f.m_feature.select("feature_name", "feature_value", "is_unknown"), "SELECT feature_name, feature_value, bool_or(is_unknown) AS is_unknown FROM b_feature GROUP BY 1, 2")
add("a16_filtered_aggregates", lambda f: f.runsum.select("pipeline_run_id", "successful_steps", "failed_steps"), "SELECT pipeline_run_id, count(*) FILTER (WHERE step_status = 'SUCCESS') AS successful_steps, count(*) FILTER (WHERE step_status = 'FAILED') AS failed_steps FROM runs JOIN reg USING (batch_id) LEFT JOIN steps USING (pipeline_run_id) GROUP BY 1")
add("a19_distinct_seeds", lambda f: f.days.select("event_batch", "event_day_number"), "SELECT DISTINCT event_batch, event_day_number FROM stg")
NEEDED = ["raw_event_id", "label", "event_day_number", "event_batch", "source_file", "ingested_at", *NUMERIC, *CATEGORICAL]
INVALID = "count(*) FILTER (WHERE impression_count <> 1) AS invalid_impression_rows, count(*) FILTER (WHERE click_flag NOT IN (0, 1)) AS invalid_click_flag_rows, count(*) FILTER (WHERE click_count NOT IN (0, 1)) AS invalid_click_count_rows"
NULLS = J(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}_rows" for c in NEEDED)


def _spoiled(f: Frames):
    """Staged rows of which some break the rules, so that the counters have something to count."""
    bad = F.col("raw_event_id") % 11 == 0
    return f.stg.withColumn("impression_count", F.when(bad, 2).otherwise(F.col("impression_count"))).withColumn("click_flag", F.when(bad, F.lit(None)).otherwise(F.col("click_flag") + (F.col("raw_event_id") % 7 == 0).cast("int"))).withColumn("i3", F.when(~bad, F.col("i3"))).withColumn("c4", F.when(~bad, F.col("c4")))


SPOILED = "(SELECT * REPLACE (CASE WHEN raw_event_id % 11 = 0 THEN 2 ELSE impression_count END AS impression_count, CASE WHEN raw_event_id % 11 = 0 THEN NULL ELSE click_flag + CAST(raw_event_id % 7 = 0 AS INT) END AS click_flag, CASE WHEN raw_event_id % 11 = 0 THEN NULL ELSE i3 END AS i3, CASE WHEN raw_event_id % 11 = 0 THEN NULL ELSE c4 END AS c4) FROM stg)"
add("a21_invalid_and_null_counters", lambda f: reports.staging_validity(_spoiled(f)), f"SELECT {INVALID}, {NULLS} FROM {SPOILED}")

# --- windows ---
RANKED = ["batch_id", "feature_name", "feature_value"]
for _name, _column in (("w2_row_number", "row_number_in_feature"), ("w3_dense_rank", "dense_rank_in_feature"), ("w4_percent_rank", "percent_rank_in_feature"), ("w5_quartile", "ctr_quartile_in_feature")):
    add(_name, lambda f, c=_column: f.r_feature.select(*RANKED, c), f"SELECT {J(RANKED)}, {_column} FROM r_feature")
add("w6_family_quintile", lambda f: f.r_lift.select("batch_id", "feature_family", "feature_name", "segment_value", "lift_quintile"), "SELECT batch_id, feature_family, feature_name, segment_value, lift_quintile FROM r_lift")
DAY = ["batch_id", "event_batch", "event_day_number"]
for _name, _columns in (("w7_change_from_day_before", ["previous_day_ctr", "ctr_change_from_previous_day"]), ("w8_running_sums", ["cumulative_impressions", "cumulative_clicks", "cumulative_ctr"]), ("w9_rolling_mean", ["rolling_3_day_avg_ctr"]), ("w10_rolling_weighted_ctr", ["rolling_3_day_weighted_ctr"])):
    add(_name, lambda f, c=_columns: f.r_rolling.select(*DAY, *c), f"SELECT {J([*DAY, *_columns])} FROM r_rolling")
PAIR = ["batch_id", "interaction_name", "left_feature_value", "right_feature_value"]
add("w11_running_clicks", lambda f: f.r_inter.select(*PAIR, "cumulative_clicks_by_interaction"), f"SELECT {J(PAIR)}, cumulative_clicks_by_interaction FROM r_inter")
add("w12_latest_of_key", lambda f: tables.latest(f.of(binding.benchmark_snapshots), ["batch_id", "benchmark_name"], [F.desc("recorded_at"), F.desc("benchmark_id")]).select("batch_id", "benchmark_name", "benchmark_id"), f"SELECT batch_id, benchmark_name, benchmark_id FROM ({O.newest('snaps', 'batch_id, benchmark_name', 'recorded_at DESC, benchmark_id DESC')})")
add("w13_distinct_on", lambda f: tables.latest(f.perf, ["model_name", "model_version"], [F.desc_nulls_first("batch_id")]).select("model_name", "model_version", "batch_id", "rows_scored"), "SELECT DISTINCT ON (model_name, model_version) model_name, model_version, batch_id, rows_scored FROM perf ORDER BY model_name, model_version, batch_id DESC NULLS FIRST")
LAGGED = [f"previous_{c}" for c in O.BEFORE]
add("w14_lags_by_scale", lambda f: ops.drift_summary(f.baseline).select("batch_id", *LAGGED), f"SELECT batch_id, {J(f'lag({c}) OVER {O.WB} AS previous_{c}' for c in O.BEFORE)} FROM base")
add("w15_lag_by_stage", lambda f: ops.stage_runtime_drift(f.trend, f.reg).select("batch_id", "layer_name", "object_name", "previous_batch_id", "previous_duration_seconds"), "SELECT t.batch_id, layer_name, object_name, lag(t.batch_id) OVER w AS previous_batch_id, lag(duration_seconds) OVER w AS previous_duration_seconds FROM trend t JOIN reg r USING (batch_id) WINDOW w AS (PARTITION BY r.source_type, t.sample_scale, layer_name, object_name ORDER BY t.batch_id)")
add("w16_lag_by_model", lambda f: f.sdrift.select("model_name", "model_version", "batch_id", "previous_batch_id", "previous_actual_ctr"), f"SELECT model_name, model_version, batch_id, lag(batch_id) OVER {O.WM} AS previous_batch_id, lag(overall_actual_ctr) OVER {O.WM} AS previous_actual_ctr FROM perf")
add("w17_first_of_scale", lambda f: tables.latest(f.reg.where(F.col("sample_scale").isin("100k", "1m", "5m")), ["sample_scale"], [F.desc_nulls_last("completed_at"), F.desc("batch_id")]).select("sample_scale", "batch_id", "completed_at"), f"SELECT sample_scale, batch_id, completed_at FROM ({O.newest('reg', 'sample_scale', 'completed_at DESC NULLS LAST, batch_id DESC')})")
add("w19_rank_in_batch", lambda f: monitor.batch_rankings(f.perf, f.mcomp).select("batch_id", "model_id", "batch_rank_by_lift", "batch_rank_by_auc"), "SELECT batch_id, model_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY top_decile_lift_vs_batch_ctr DESC NULLS FIRST, validation_roc_auc DESC NULLS FIRST) AS batch_rank_by_lift, dense_rank() OVER (PARTITION BY batch_id ORDER BY validation_roc_auc DESC NULLS FIRST, top_decile_lift_vs_batch_ctr DESC NULLS FIRST) AS batch_rank_by_auc FROM perf LEFT JOIN (SELECT DISTINCT model_name, model_version, training_run_id, validation_roc_auc FROM mcomp) USING (model_name, model_version, training_run_id)")

# --- unions ---
SEGMENT = ["batch_id", "segment_type", "segment_name", "segment_value", "impressions", "clicks"]
add("u1_segment_families", lambda f: ranked._segments(f.b_feature, f.b_bucket, f.b_inter, f.b_overall, HIGH, MEDIUM, MEDIUM_BUCKET).select(*SEGMENT), f"SELECT {J(SEGMENT)} FROM segments")
FAMILY = ["batch_id", "feature_family", "feature_name", "segment_value", "impressions", "clicks"]
add("u2_feature_families", lambda f: f.r_lift.select(*FAMILY), "SELECT batch_id, 'categorical_feature' AS feature_family, feature_name, feature_value AS segment_value, impressions, clicks FROM b_feature UNION ALL SELECT batch_id, 'numeric_bucket', feature_name, bucket_label, impressions, clicks FROM b_bucket")
add("u3_interactions", lambda f: f.b_inter.select(*PAIR, "impressions"), f"SELECT {J(PAIR)}, impressions FROM b_inter1 UNION ALL SELECT {J(PAIR)}, impressions FROM b_inter2 UNION ALL SELECT {J(PAIR)}, impressions FROM b_inter3")
add("u4_check_results", lambda f: quality.raw_checks(f.imp).unionByName(quality.staging_checks(f.imp, f.stg)).select("layer_name", "check_status"), "SELECT 'raw' AS layer_name, 'PASS' AS check_status FROM range(4) UNION ALL SELECT 'staging', 'PASS' FROM range(5)")

# --- drift, features, models ---
add("d3_drift_label", lambda f: ops.drift_summary(f.baseline).select("batch_id", "drift_status"), "SELECT batch_id, drift_status FROM drift")
BUCKET_SUMS, VALUE_SUMS = ("bucket_lift_sum", "bucket_lift_mean", "bucket_lift_max", "bucket_lift_positive_count", "bucket_lift_negative_count"), ("categorical_lift_sum", "categorical_lift_mean", "categorical_lift_max", "categorical_support_log_sum", "categorical_support_log_mean", "numeric_log_sum", "numeric_log_mean", "numeric_log_max")
for _name, _columns in (("f6_bucket_lift_aggregates", BUCKET_SUMS), ("f7_value_and_log_aggregates", VALUE_SUMS)):
    add(_name, lambda f, c=_columns: f.store.select("raw_event_id", *(F.round(features.aggregates()[n].cast("double"), 8).alias(n) for n in c)), f"SELECT raw_event_id, {J(f'round(CAST({O.AGGS[n]} AS DOUBLE), 8) AS {n}' for n in _columns)} FROM store")


def _encoded(f: Frames):
    """How many places the one-hot vector has, how many of them are set, and which standardised numbers it holds; of raw impressions, with their nulls."""
    from pyspark.ml.functions import vector_to_array

    numeric, categorical = ["i1", "i2"], ["c22"]
    rows = f.imp.select("event_id", *numeric, *categorical)
    vector = vector_to_array("features")
    out = train.fit_encoder(rows, numeric, categorical).transform(rows)
    n = len(numeric)
    return out.select(F.col("event_id").alias("raw_event_id"), F.size(vector).alias("places"), F.round(F.aggregate(F.slice(vector, n + 1, F.size(vector) - n), F.lit(0.0), lambda a, x: a + x), 6).alias("ones"), *(F.round(vector[i], 5).alias(c) for i, c in enumerate(numeric)))


STANDARD = J(f"round((coalesce(s.{c}, 0) - m.a_{c}) / m.d_{c}, 5) AS {c}" for c in ("i1", "i2"))
add("f13_onehot_standardised", _encoded, f"SELECT s.event_id AS raw_event_id, CAST(m.kinds + 2 AS INT) AS places, 1e0 AS ones, {STANDARD} FROM imp s, (SELECT count(DISTINCT coalesce(c22, 'unknown')) AS kinds, avg(coalesce(i1, 0)) AS a_i1, stddev_pop(coalesce(i1, 0)) AS d_i1, avg(coalesce(i2, 0)) AS a_i2, stddev_pop(coalesce(i2, 0)) AS d_i2 FROM imp) m")


def _bundle(f: Frames):
    """Scores of a model with its calibrator beside its own: the calibrator's curve over them, and the rows' deciles."""
    frame, names = f.ml
    model = train.fit_engineered(frame.where("dataset_split = 'train'"), names, "logistic", reg=1e-2)
    keep = ["raw_event_id", "dataset_split", "label"]
    plain = saved(train.score(frame, model, keep), "plain")
    fitted, _ = train.calibrate(plain.where("dataset_split = 'validation'"), "sigmoid")
    both = train.score(frame, model, keep, "calibrated", fitted).join(plain.select("raw_event_id", "score"), "raw_event_id")
    return evaluate.with_deciles(both, ["dataset_split"], "calibrated").select(*keep, "score", "calibrated", "score_decile")


add("l13_scored_with_calibrator", _bundle)
add("l18_feature_groups", lambda f: f.coef.select("feature_name", importance.feature_group(F.col("feature_name")).alias("feature_group")).distinct(), "SELECT DISTINCT feature_name, feature_group FROM imp0")
add("l19_interpretation_notes", lambda f: importance.importance(f.coef, ["model_id", "training_run_id"]).select("model_id", "training_run_id", "feature_name", "interpretation_note"), "SELECT model_id, training_run_id, feature_name, interpretation_note FROM imp0")
add("l21_candidates_active_base", lambda f: _decided(f).select("model_id", "training_run_id", "rows_trained", *promote.METRICS), "SELECT DISTINCT m.model_id, c.training_run_id, c.rows_trained, c.validation_roc_auc, c.validation_pr_auc, c.validation_lift_at_10pct FROM mcomp c JOIN models m USING (model_name, model_version)")
add("k2_stratified_sample", lambda f: sampling.nested_samples(f.imp.select("event_id", "label"), {"medium": SIZES["medium"]}).select("event_id", "label"), f"SELECT event_id, label FROM ({SAMPLES}) WHERE sample_name = 'medium'")


# --- streaming ---
def _batch_of(f: Frames, path: str):
    from adloom.streaming import intake

    return f.spark.read.schema(intake.source_schema()).option("header", True).csv(path).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def _status_driven(f: Frames):
    """The same content comes four times, and once more within the first micro-batch under the same file name in another folder. The second is passed over,
    as the first is done; after that the first is marked as failed, so the third is taken in; then that is archived, so the fourth is passed over."""
    from adloom.streaming import intake

    inbox, store = queries.inbox_of(f, {"a": 1}), f.path("store")
    log = intake.log_of(f.spark, store)
    file = f.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{inbox}/a").select("path").first()["path"]
    log.copy(file, f"{inbox}/b")
    first, again = _batch_of(f, f"{inbox}/*"), _batch_of(f, f"{inbox}/a")
    taken = [intake.process(first, 0, store), intake.process(again, 1, store)]
    intake.set_status(f.spark, store, 1, "FAILED")
    taken.append(intake.process(again, 2, store))
    intake.set_status(f.spark, store, 3, "ARCHIVED")
    taken.append(intake.process(again, 3, store))
    rows = intake.registry(f.spark, store).groupBy("batch_id", "batch_status").agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("files"))
    staged = intake.table(f.spark, store, "staging").agg(F.count(F.lit(1)).alias("staged"))
    return rows.withColumn("taken", F.lit("".join(map(str, taken)))).crossJoin(F.broadcast(staged))


add("x2_status_driven_intake", _status_driven, "SELECT CAST(b AS BIGINT) AS batch_id, s AS batch_status, CAST(count(*) * files AS BIGINT) AS row_count, CAST(files AS BIGINT) AS files, '1010' AS taken, count(*) AS staged FROM imp, (VALUES (1, 'FAILED', 2), (2, 'DUPLICATE', 1), (3, 'ARCHIVED', 1), (4, 'DUPLICATE', 1)) v(b, s, files) WHERE batch_id = 1 GROUP BY b, s, files")


def _micro_batches(f: Frames):
    """Staged rows of three files that came one by one; then the last micro-batch comes again, after its commit and, as if that had been lost, before it.
    Each row is there once, ids are unique, and each batch has its days and marts."""
    from adloom.streaming import intake

    inbox, store = queries.inbox_of(f, {"1": 1, "2": 2, "3": 3}), f.path("store")
    intake.run(f.spark, f"{inbox}/*", store, f.path("checkpoint"))
    last = intake.registry(f.spark, store).orderBy(F.desc("epoch")).first()
    batch = f.spark.read.schema(intake.source_schema()).option("header", True).csv(last["source_path"]).withColumn("source_file", F.lit(last["source_file"])).withColumn("source_path", F.lit(last["source_path"]))
    intake.process(batch, last["epoch"], store, last["query"])
    intake.set_status(f.spark, store, last["batch_id"], "STARTED")
    intake.process(batch, last["epoch"], store, last["query"])
    staged = intake.table(f.spark, store, "staging")
    ids = staged.agg(F.countDistinct("raw_event_id").alias("ids"), F.count(F.lit(1)).alias("row_count"), F.sum("click_count").alias("clicks"), F.countDistinct("batch_id").alias("batches"), F.max("batch_id").alias("last_batch"))
    mart = intake.table(f.spark, store, "marts/event_day").agg(F.sum("impressions").alias("impressions"), F.count(F.lit(1)).alias("days"))
    return ids.crossJoin(F.broadcast(mart))


add("x3_micro_batches", _micro_batches, "SELECT count(*) AS ids, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS clicks, count(DISTINCT batch_id) AS batches, CAST(3 AS BIGINT) AS last_batch, count(*) AS impressions, CAST(sum(days) FILTER (WHERE first) AS BIGINT) AS days FROM (SELECT *, least(7, count(*) OVER (PARTITION BY batch_id)) AS days, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) = 1 AS first FROM imp WHERE batch_id IN (1, 2, 3))")


def _archived(f: Frames):
    """An inbox of four files, one of them a copy, that is archived: every file has left it, all are in the archive and the registry has their places,
    and each content is staged once."""
    from adloom.streaming import intake

    inbox, store, archive = queries.inbox_of(f, {"1": 1, "2": 2, "3": 3, "4": 2}), f.path("store"), f.path("archive")
    intake.run(f.spark, f"{inbox}/*", store, f.path("checkpoint"), archive)
    intake.run(f.spark, f"{inbox}/*", store, f.path("checkpoint"), archive)  # an inbox that is empty now, and a new checkpoint
    names = lambda path, name: f.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).agg(F.count(F.lit(1)).alias(name))
    placed = intake.registry(f.spark, store).join(f.spark.read.format("binaryFile").load(archive).select(F.col("path").alias("archive_path")), "archive_path").agg(F.count(F.lit(1)).alias("placed"), F.count(F.when(F.col("batch_status") == "ARCHIVED", 1)).alias("archived"))
    out = intake.table(f.spark, store, "staging").agg(F.count(F.lit(1)).alias("row_count"))
    for one in (names(inbox, "in_inbox"), names(archive, "in_archive"), placed):
        out = out.crossJoin(F.broadcast(one))
    return out


add("x4_archived_inbox", _archived, "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS in_inbox, count(DISTINCT batch_id) + 1 AS in_archive, count(DISTINCT batch_id) + 1 AS placed, count(DISTINCT batch_id) AS archived FROM imp WHERE batch_id IN (1, 2, 3)")

# --- reports on layers, listings and pages ---
LAYERS = {"raw": ("imp", lambda f: f.imp), "staging": ("stg", lambda f: f.stg), "fact": ("fact", lambda f: f.fact), "dim_event_day": ("dday", lambda f: f.days), "numeric_bridge": ("long_n", lambda f: warehouse.unpivot(f.stg, NUMERIC, [])), "categorical_bridge": ("long_c", lambda f: warehouse.unpivot(f.stg, CATEGORICAL, []))}
add("q12_layer_counts", lambda f: reports.table_counts({n: make(f) for n, (_, make) in LAYERS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, (t, _) in LAYERS.items()))
MARTS = {"overall": "m_overall", "event_day": "m_day", "numeric_bucket": "m_bucket", "feature": "m_feature", "missing": "m_missing", "interaction": "m_inter", "feature_ranked": "r_feature", "rolling": "r_rolling", "high_value": "r_high", "low_performing": "r_low", "lift_ranked": "r_lift", "interaction_ranked": "r_inter"}
add("q12_mart_counts", lambda f: reports.table_counts({n: getattr(f, t) for n, t in MARTS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in MARTS.items()))
add("q12_staging_by_day", lambda f: reports.by_day(f.stg), "SELECT event_batch, event_day_number, count(*) AS row_count, CAST(sum(click_count) AS BIGINT) AS click_count, round(CAST(sum(click_count) AS DOUBLE) / nullif(sum(impression_count), 0), 6) AS ctr FROM stg GROUP BY 1, 2")
add("q12_staging_validity", lambda f: reports.staging_validity(f.stg), f"SELECT {INVALID}, {NULLS} FROM stg")
add("q12_staging_missing", lambda f: reports.staging_missing(f.stg), "SELECT max(missing_numeric_count) AS max_missing_numeric_count, max(missing_categorical_count) AS max_missing_categorical_count, round(avg(missing_numeric_count), 6) AS avg_missing_numeric_count, round(avg(missing_categorical_count), 6) AS avg_missing_categorical_count FROM stg")
add("q12_fact_validity", lambda f: reports.fact_validity(f.fact), f"SELECT {INVALID} FROM fact")
add("q12_unknown_values", lambda f: warehouse.dim_categorical_value(f.stg).where("is_unknown").agg(F.count(F.lit(1)).alias("unknown_categorical_dimension_rows")), "SELECT count(DISTINCT feature_name) AS unknown_categorical_dimension_rows FROM long_c WHERE feature_value = 'unknown'")
add("q12_store_validity", lambda f: reports.store_validity(f.store), "SELECT count(*) FILTER (WHERE label NOT IN (0, 1)) AS invalid_label_rows, count(*) FILTER (WHERE raw_event_id IS NULL) AS null_raw_event_id_rows, count(*) FILTER (WHERE batch_id IS NULL) AS null_batch_id_rows, count(*) FILTER (WHERE overall_ctr < 0 OR overall_ctr > 1) AS invalid_overall_ctr_rows, count(*) FILTER (WHERE event_day_number NOT BETWEEN 1 AND 7) AS invalid_event_day_rows FROM store")
OPS = {"batch_registry": ("reg", lambda f: f.reg), "pipeline_runs": ("runs", lambda f: f.of(binding.pipeline_runs)), "pipeline_steps": ("steps", lambda f: f.of(binding.pipeline_steps)), "pipeline_alerts": ("alerts", lambda f: f.of(binding.pipeline_alerts)), "benchmark_snapshots": ("snaps", lambda f: f.of(binding.benchmark_snapshots)), "run_summary": ("runsum", lambda f: f.runsum), "benchmark_summary": ("bench", lambda f: f.bench), "metric_baseline": ("base", lambda f: f.baseline), "validation_results": ("vres", lambda f: f.of(binding.validation_results)), "validation_runs": ("vruns", lambda f: f.of(binding.validation_runs))}
add("q12_ops_counts", lambda f: reports.table_counts({n: make(f) for n, (_, make) in OPS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, (t, _) in OPS.items()))
MODELS = {"model_registry": ("models", lambda f: f.models), "training_runs": ("truns", lambda f: f.truns), "model_metrics": ("tmetrics", lambda f: f.tmetrics), "prediction_scores": ("scores", lambda f: f.scores), "top_decile_performance": ("perf", lambda f: f.perf), "score_drift": ("sdrift", lambda f: f.sdrift), "model_comparison": ("mcomp", lambda f: f.mcomp), "active_canonical_model": ("active", lambda f: f.active)}
add("q12_model_counts", lambda f: reports.table_counts({n: make(f) for n, (_, make) in MODELS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, (t, _) in MODELS.items()))
SCORES = ["raw_event_id", "batch_id", "model_id", "actual_click", "predicted_ctr", "model_name", "model_version", "training_run_id", "score_decile", "is_top_decile"]
add("q12_score_columns", lambda f: f.spark.createDataFrame([(n, k) for n, k, _ in reports.columns_of(f.scores.select(*SCORES))], "column_name string, data_type string").join(f.scores.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left").select("column_name", "data_type"), "SELECT column_name, data_type FROM (VALUES ('raw_event_id', 'bigint'), ('batch_id', 'bigint'), ('model_id', 'bigint'), ('actual_click', 'int'), ('predicted_ctr', 'double'), ('model_name', 'string'), ('model_version', 'string'), ('training_run_id', 'bigint'), ('score_decile', 'int'), ('is_top_decile', 'boolean')) v(column_name, data_type)")


def listing(name: str, make, table: str, columns: list[str], order: list[str], n: int | None = None, where: str = "true") -> None:
    """A listing and its SQL. order: columns, with a minus for descending ones (nulls last either way); n rows, or all."""
    spark_order = lambda: [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]
    sql_order = J(f"{c[1:]} DESC NULLS LAST" if c.startswith("-") else f"{c} NULLS LAST" for c in order)
    add(name, lambda f: reports.listing(make(f).where(where), columns, spark_order(), n), f"SELECT {J(columns)} FROM {table} WHERE {where} ORDER BY {sql_order}" + (f" LIMIT {n}" if n else ""))


RATE = ["impressions", "clicks", "ctr"]
LIFTED = [*RATE, "ctr_lift_vs_overall"]
IN_FEATURE = ["feature_name", "ctr_rank_in_feature", "-impressions"]
listing("t3_event_days", lambda f: f.m_day, "m_day", ["event_batch", "event_day_number", *RATE], ["event_day_number", "event_batch"])
listing("t3_numeric_buckets", lambda f: f.m_bucket, "m_bucket", ["feature_name", "bucket_label", *LIFTED], [*IN_FEATURE, "bucket_label"], 20, "ctr_rank_in_feature <= 3")
listing("t3_top_numeric_buckets", lambda f: marts.top(f.m_bucket, "ctr_rank_in_feature", MEDIUM_BUCKET), "m_bucket", ["feature_name", "bucket_label", *LIFTED, "volume_band"], [*IN_FEATURE, "bucket_label"], 20, f"ctr_rank_in_feature <= 5 AND impressions >= {MEDIUM_BUCKET}")
listing("t3_features", lambda f: f.m_feature, "m_feature", ["feature_name", "feature_value", *LIFTED], [*IN_FEATURE, "feature_value"], 20, "ctr_rank_in_feature <= 3")
listing("t3_top_features", lambda f: marts.top(f.m_feature, "ctr_rank_in_feature", MEDIUM), "m_feature", ["feature_name", "feature_value", *LIFTED, "volume_band"], [*IN_FEATURE, "feature_value"], 20, f"ctr_rank_in_feature <= 5 AND impressions >= {MEDIUM}")
listing("t3_missing_values", lambda f: f.m_missing, "m_missing", ["missing_type", "missing_count", *LIFTED], ["missing_type", "missing_count"])
SIDES = ["left_feature_value", "right_feature_value"]
listing("t3_interactions", lambda f: f.m_inter, "m_inter", ["interaction_name", "left_feature_name", "left_feature_value", "right_feature_name", "right_feature_value", *LIFTED], ["interaction_name", "ctr_rank_in_interaction", "-impressions", *SIDES], 30, "ctr_rank_in_interaction <= 10")
listing("t3_rolling_days", lambda f: f.r_rolling, "r_rolling", ["batch_id", "event_batch", "event_day_number", "ctr", "previous_day_ctr", "ctr_change_from_previous_day", "cumulative_ctr", "rolling_3_day_avg_ctr", "rolling_3_day_weighted_ctr"], ["event_day_number", "batch_id", "event_batch"])
listing("t3_features_ranked", lambda f: f.r_feature, "r_feature", ["batch_id", "feature_name", "feature_value", *LIFTED, "volume_band", "dense_rank_in_feature", "percent_rank_in_feature", "ctr_quartile_in_feature"], ["feature_name", "dense_rank_in_feature", "-impressions", "batch_id", "feature_value"], 25, "dense_rank_in_feature <= 3")
SEGMENTS = ["batch_id", "segment_type", "segment_name", "segment_value", *LIFTED, "volume_band"]
listing("t3_high_value_segments", lambda f: f.r_high, "r_high", [*SEGMENTS, "segment_rank_by_lift"], ["segment_type", "segment_rank_by_lift", "-impressions", "batch_id", "segment_name", "segment_value"], 30, "segment_rank_by_lift <= 10")
listing("t3_low_performing_segments", lambda f: f.r_low, "r_low", [*SEGMENTS, "segment_rank_by_underperformance"], ["segment_type", "segment_rank_by_underperformance", "-impressions", "batch_id", "segment_name", "segment_value"], 30, "segment_rank_by_underperformance <= 10")
listing("t3_lift_ranked", lambda f: f.r_lift, "r_lift", ["batch_id", "feature_family", "feature_name", "segment_value", *LIFTED, "volume_band", "dense_rank_by_lift", "lift_quintile"], ["feature_family", "feature_name", "dense_rank_by_lift", "-impressions", "batch_id", "segment_value"], 30, "dense_rank_by_lift <= 5")
listing("t3_interactions_ranked", lambda f: f.r_inter, "r_inter", ["batch_id", "interaction_name", *SIDES, *LIFTED, "volume_band", "dense_rank_in_interaction", "percent_rank_in_interaction", "cumulative_clicks_by_interaction"], ["interaction_name", "dense_rank_in_interaction", "-impressions", "batch_id", *SIDES], 30, "dense_rank_in_interaction <= 10")
listing("t3_batches", lambda f: f.reg, "reg", ["batch_id", "batch_name", "source_file", "sample_scale", "expected_row_count", "batch_status", "created_at", "completed_at"], ["-batch_id"], 10)
listing("t3_runs", lambda f: f.of(binding.pipeline_runs), "runs", ["pipeline_run_id", "batch_id", "pipeline_name", "layer_name", "run_status", "started_at"], ["-pipeline_run_id"], 20)
listing("t3_alerts", lambda f: f.of(binding.pipeline_alerts), "alerts", ["alert_id", "batch_id", "alert_level", "alert_run_id"], ["-alert_id"], 30)
listing("t3_benchmarks", lambda f: f.bench, "bench", ["benchmark_id", "batch_id", "benchmark_name", "layer_name", "object_name", "row_count", "duration_seconds", "rows_per_second", "storage_mb", "recorded_at"], ["-benchmark_id"], 50)
listing("t3_validation_audit", lambda f: f.of(binding.validation_results), "vres", ["validation_id", "layer_name", "check_name", "check_status", "checked_at"], ["-validation_id"], 10, "layer_name = 'layer_1'")
listing("t3_baseline", lambda f: f.baseline, "base", ["batch_id", "batch_name", "source_type", "sample_scale", "fact_rows", "ctr", "total_stage_runtime_seconds", "failed_quality_checks", "total_alerts"], ["-batch_id"], 10)
listing("t3_stage_drift", lambda f: ops.stage_runtime_drift(f.trend, f.reg).select("batch_id", "batch_name", "layer_name", "object_name", "duration_seconds"), "trend", ["batch_id", "batch_name", "layer_name", "object_name", "duration_seconds"], ["-batch_id", "-duration_seconds", "layer_name", "object_name"], 20)
OPS_PAGE = ["batch_id", "batch_name", "source_file", "source_type", "sample_scale", "batch_status", "created_at", "completed_at", "batch_elapsed_seconds", "orchestration_run_id", "latest_quality_run_id", "latest_quality_run_status", "total_quality_checks", "passed_quality_checks", "warning_quality_checks", "failed_quality_checks", "total_alerts", "error_alerts", "warning_alerts", "total_stage_runtime_seconds", "slowest_stage_runtime_seconds"]
listing("o12_health_page", lambda f: f.health, "health", OPS_PAGE, ["-batch_id"])
listing("o12_runtime_page", lambda f: f.trend, "trend", ["batch_id", "batch_name", "sample_scale", "layer_name", "object_name", "duration_seconds", "rows_per_second", "row_count", "storage_mb", "recorded_at"], ["-recorded_at", "-duration_seconds", "batch_id", "layer_name", "object_name"])
MODEL = ["model_name", "model_version", "training_run_id"]
GAPS = ["promotion_status", "promotion_roc_auc_gap", "promotion_pr_auc_gap", "promotion_lift_gap"]
VALID = ["validation_roc_auc", "validation_pr_auc", "validation_log_loss", "validation_lift_at_10pct", "test_roc_auc", "test_pr_auc", "test_log_loss"]
listing("n14_active_page", lambda f: monitor.active_dashboard(f.dash), "dash", [*MODEL, "train_batch_name", "is_active_canonical", *VALID, "top_decile_lift_vs_batch_ctr", "overall_avg_predicted_ctr", "overall_actual_ctr", *GAPS, "canonical_promotion_note"], MODEL, None, "is_active_canonical")
DASH = [*MODEL, "train_batch_name", "training_scale_band", "is_canonical_1m_run", "is_active_canonical", "canonical_promotion_note", "rows_trained", "rows_validated", "rows_tested", *VALID, "validation_precision_at_10pct", "test_precision_at_10pct", "test_lift_at_10pct", "latest_scored_batch_id", "latest_scored_batch_name", "rows_scored", "overall_avg_predicted_ctr", "overall_actual_ctr", "top_decile_rows", "top_decile_avg_predicted_ctr", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr", "top_decile_predicted_ctr_gap", "top_decile_actual_ctr_gap", "previous_batch_id", "previous_batch_name", "avg_predicted_ctr_delta", "actual_ctr_delta", "top_decile_actual_ctr_delta", "top_decile_lift_delta", "active_validation_roc_auc", "active_validation_pr_auc", "active_validation_lift_at_10pct", *GAPS, "validation_quality_band", "ranking_quality_band", "drift_severity", "comparison_note"]
listing("n14_dashboard_page", lambda f: f.dash, "dash", DASH, ["-validation_roc_auc", "-top_decile_lift_vs_batch_ctr", *MODEL])
RANKS = ["batch_id", "batch_name", "model_id", "training_run_id", "model_name", "model_version", "rows_scored", "top_decile_rows", "top_decile_lift_vs_batch_ctr"]
listing("n14_rankings_page", lambda f: monitor.batch_rankings(f.perf, f.mcomp), "perf", RANKS, ["-batch_id", "model_id"])
WATCH = ["batch_id", "batch_name", "model_id", "training_run_id", "model_name", "model_version", "previous_batch_id", "previous_batch_name", "overall_avg_predicted_ctr", "overall_actual_ctr", "top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr", "avg_predicted_ctr_delta", "actual_ctr_delta", "top_decile_actual_ctr_delta", "top_decile_lift_delta", "drift_status", "drift_note"]
listing("n14_watchlist_page", lambda f: f.watch, "watch", WATCH, ["-batch_id", "-drift_status", "model_name", "model_version"])
IMPORTANCE = [*MODEL, "feature_name", "feature_group", "importance_value", "abs_importance_value", "relative_importance_pct", "importance_direction", "interpretation_note"]
listing("n14_importance_page", lambda f: f.limp, "limp", IMPORTANCE, ["model_name", "model_version", "importance_rank"])
add("n14_groups_page", lambda f: monitor.group_importance(f.limp).orderBy("model_name", "model_version", F.desc("total_abs_importance"), "feature_group"), "SELECT model_name, model_version, training_run_id, feature_group, count(*) AS features_in_group, round(sum(abs_importance_value), 8) AS total_abs_importance, round(avg(abs_importance_value), 8) AS avg_abs_importance, round(max(abs_importance_value), 8) AS max_abs_importance, round(sum(relative_importance_pct), 6) AS group_relative_importance_pct FROM limp GROUP BY ALL")
