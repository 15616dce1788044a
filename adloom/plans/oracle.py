"""The same tables in DuckDB's SQL, as views that are put in front of a query when it names them."""

from __future__ import annotations

import re

from adloom.functions.columns import CATEGORICAL, NUMERIC, STORED
from adloom.sources.binding import FEATURES

VIEWS: dict[str, str] = {}


def _join(parts, sep=", "):
    return sep.join(parts)


def bucket(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN 'negative' WHEN {c} = 0 THEN 'zero' WHEN {c} BETWEEN 1 AND 10 THEN '1_10' WHEN {c} BETWEEN 11 AND 100 THEN '11_100' WHEN {c} BETWEEN 101 AND 1000 THEN '101_1000' WHEN {c} BETWEEN 1001 AND 10000 THEN '1001_10000' ELSE '10001_plus' END"


def _label(c: str) -> str:
    return f"CASE {c} WHEN 'negative' THEN 'negative values' WHEN 'zero' THEN '0' WHEN '1_10' THEN '1 to 10' WHEN '11_100' THEN '11 to 100' WHEN '101_1000' THEN '101 to 1000' WHEN '1001_10000' THEN '1001 to 10000' ELSE '10001 and above' END"


def _order(c: str) -> str:
    return f"CASE {c} WHEN 'negative' THEN 1 WHEN 'zero' THEN 2 WHEN '1_10' THEN 3 WHEN '11_100' THEN 4 WHEN '101_1000' THEN 5 WHEN '1001_10000' THEN 6 ELSE 7 END"


def ratio(a: str, b: str, places: int = 6) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), {places})"


def band(c: str, high: int, medium: int) -> str:
    return f"CASE WHEN {c} >= {high} THEN 'high' WHEN {c} >= {medium} THEN 'medium' ELSE 'low' END"


def _numbers() -> str:
    out = ["CAST(CASE WHEN event_id % 10 = 0 THEN NULL ELSE floor(value) END AS INT) AS i1", "CAST(CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id - 20 END AS INT) AS i2", "CAST(json_extract_string(props, '$.k') AS INT) AS i3"]
    out += [f"CAST(CASE WHEN event_id % {j + 3} = 0 THEN NULL ELSE (event_id * {j} + user_id) % {5 * 10 ** (j % 5)} - {j % 3} END AS INT) AS i{j}" for j in range(4, 14)]
    return _join(out)


def _values() -> str:
    out = []
    for j in range(1, 27):
        if j == 22:
            out.append("CASE WHEN user_id % 9 = 0 THEN NULL ELSE concat('g', CAST(user_id % 4 AS VARCHAR)) END AS c22")
        else:
            out.append(f"CASE WHEN (event_id + {j}) % {j % 9 + 3} = 0 THEN '' WHEN (event_id + {j}) % {j % 9 + 17} = 0 THEN NULL ELSE concat('v', CAST((user_id * {j} + hour(ts)) % {3 * j + 2} AS VARCHAR)) END AS c{j}")
    return _join(out)


VIEWS["imp"] = f"""SELECT event_id, CAST(floor((day(ts) - 1) / 10.0) + 1 AS BIGINT) AS batch_id,
 CAST(CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND user_id % 4 = 0) THEN 1 ELSE 0 END AS INT) AS label, {_numbers()}, {_values()},
 CASE WHEN day(ts) <= 10 THEN 'events_100k.csv' WHEN day(ts) <= 20 THEN 'events_1m.csv' ELSE concat('events_live_', CAST(CAST(floor((day(ts) - 1) / 10.0) + 1 AS BIGINT) AS VARCHAR), '.csv') END AS source_file,
 ts AS ingested_at FROM events"""
MISSING_N = _join((f"CAST({c} IS NULL AS INT)" for c in NUMERIC), " + ")
MISSING_C = _join((f"CAST(({c} IS NULL OR {c} = '') AS INT)" for c in CATEGORICAL), " + ")
VIEWS["stg"] = f"""SELECT event_id AS raw_event_id, batch_id, CAST(CASE WHEN coalesce(label, 0) = 1 THEN 1 ELSE 0 END AS INT) AS label,
 {_join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC)}, {_join(f"coalesce(nullif({c}, ''), 'unknown') AS {c}" for c in CATEGORICAL)},
 CAST(ntile(7) OVER (PARTITION BY source_file ORDER BY event_id) AS INT) AS event_day_number,
 CASE WHEN source_file LIKE '%100k%' THEN '100k' WHEN source_file LIKE '%1m%' THEN '1m' WHEN source_file LIKE '%5m%' THEN '5m' ELSE 'full' END AS event_batch,
 label AS click_flag, 1 AS impression_count, label AS click_count,
 {MISSING_N} AS missing_numeric_count, {MISSING_C} AS missing_categorical_count, source_file, ingested_at FROM imp"""
VIEWS["dday"] = "SELECT row_number() OVER (ORDER BY event_batch, event_day_number) AS event_day_key, event_batch, event_day_number, concat('training_day_', CAST(event_day_number AS VARCHAR)) AS day_label FROM (SELECT DISTINCT event_batch, event_day_number FROM stg)"
VIEWS["fact"] = "SELECT raw_event_id, batch_id, event_day_key, label, click_flag, impression_count, click_count, missing_numeric_count, missing_categorical_count, event_batch, source_file, ingested_at FROM stg JOIN dday USING (event_batch, event_day_number)"
SUMS = f"count(*) AS impressions, CAST(sum(click_count) AS BIGINT) AS clicks, {ratio('sum(click_count)', 'count(*)')} AS ctr"
AVGS = "round(avg(missing_numeric_count), 6) AS avg_missing_numeric_count, round(avg(missing_categorical_count), 6) AS avg_missing_categorical_count"
VIEWS["b_overall"] = f"SELECT batch_id, max(source_file) AS source_file, max(event_batch) AS event_batch, {SUMS}, {AVGS} FROM fact GROUP BY batch_id"
VIEWS["b_day"] = f"SELECT batch_id, d.event_batch, d.event_day_number, d.day_label, {SUMS} FROM fact f JOIN dday d USING (event_day_key) GROUP BY ALL"
LONG_N = _join((f"SELECT raw_event_id, batch_id, click_count, '{c}' AS feature_name, {c} AS feature_value FROM stg" for c in NUMERIC), " UNION ALL ")
LONG_C = _join((f"SELECT raw_event_id, batch_id, click_count, '{c}' AS feature_name, {c} AS feature_value FROM stg" for c in CATEGORICAL), " UNION ALL ")
VIEWS["long_n"] = f"SELECT *, {bucket('feature_value')} AS bucket_code FROM ({LONG_N})"
VIEWS["long_c"] = LONG_C
VIEWS["b_bucket"] = f"SELECT batch_id, feature_name, bucket_code, {_label('bucket_code')} AS bucket_label, {_order('bucket_code')} AS bucket_order, {SUMS} FROM long_n GROUP BY batch_id, feature_name, bucket_code"
VIEWS["b_feature"] = f"SELECT batch_id, feature_name, feature_value, feature_value = 'unknown' AS is_unknown, {SUMS} FROM long_c GROUP BY batch_id, feature_name, feature_value"
VIEWS["b_missing"] = f"SELECT batch_id, 'missing_numeric_count' AS missing_type, missing_numeric_count AS missing_count, {SUMS} FROM fact GROUP BY ALL UNION ALL SELECT batch_id, 'missing_categorical_count', missing_categorical_count, {SUMS} FROM fact GROUP BY ALL"


def inter(name: str, left: str, value: str, right: str) -> str:
    return f"SELECT batch_id, '{name}' AS interaction_name, '{left}' AS left_feature_name, {value} AS left_feature_value, '{right}' AS right_feature_name, {right} AS right_feature_value, {SUMS} FROM stg GROUP BY ALL"


VIEWS["b_inter1"] = inter("categorical_pair_c22_c19", "c22", "c22", "c19")
VIEWS["b_inter2"] = inter("categorical_pair_c22_c6", "c22", "c22", "c6")
VIEWS["b_inter3"] = inter("numeric_categorical_i1_c22", "i1_bucket", bucket("i1"), "c22")
VIEWS["b_inter"] = "SELECT * FROM b_inter1 UNION ALL SELECT * FROM b_inter2 UNION ALL SELECT * FROM b_inter3"
ADD = f"CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, {ratio('sum(clicks)', 'sum(impressions)')} AS ctr"
VIEWS["m_overall"] = f"SELECT 'all_loaded_batches' AS scope_name, {ADD}, {ratio('sum(avg_missing_numeric_count * impressions)', 'sum(impressions)')} AS avg_missing_numeric_count, {ratio('sum(avg_missing_categorical_count * impressions)', 'sum(impressions)')} AS avg_missing_categorical_count FROM b_overall"
HIGH, MEDIUM, MEDIUM_BUCKET = 500, 100, 200
LIFT = "(SELECT ctr FROM m_overall) AS overall_ctr, round(ctr - (SELECT ctr FROM m_overall), 6) AS ctr_lift_vs_overall"
VIEWS["m_day"] = f"SELECT *, dense_rank() OVER (PARTITION BY event_batch ORDER BY ctr DESC NULLS FIRST) AS ctr_rank_in_batch, dense_rank() OVER (PARTITION BY event_batch ORDER BY impressions DESC) AS impression_rank_in_batch FROM (SELECT event_batch, event_day_number, day_label, {ADD} FROM b_day GROUP BY ALL)"


def m_bucket(high: int, medium: int) -> str:
    return f"SELECT *, {LIFT}, {band('impressions', high, medium)} AS volume_band, dense_rank() OVER (PARTITION BY feature_name ORDER BY ctr DESC NULLS FIRST) AS ctr_rank_in_feature, dense_rank() OVER (PARTITION BY feature_name ORDER BY impressions DESC) AS impression_rank_in_feature FROM (SELECT feature_name, bucket_code, bucket_label, bucket_order, {ADD} FROM b_bucket GROUP BY ALL)"


VIEWS["m_bucket"] = m_bucket(HIGH, MEDIUM_BUCKET)
VIEWS["m_feature"] = f"SELECT *, {LIFT}, {band('impressions', HIGH, MEDIUM)} AS volume_band, dense_rank() OVER (PARTITION BY feature_name ORDER BY ctr DESC NULLS FIRST, impressions DESC) AS ctr_rank_in_feature, dense_rank() OVER (PARTITION BY feature_name ORDER BY impressions DESC, ctr DESC NULLS FIRST) AS impression_rank_in_feature FROM (SELECT feature_name, feature_value, bool_or(is_unknown) AS is_unknown, {ADD} FROM b_feature GROUP BY feature_name, feature_value)"
VIEWS["m_missing"] = f"SELECT *, {LIFT} FROM (SELECT missing_type, missing_count, {ADD} FROM b_missing GROUP BY ALL)"
VIEWS["m_inter"] = f"SELECT *, {LIFT}, {band('impressions', HIGH, MEDIUM)} AS volume_band, dense_rank() OVER (PARTITION BY interaction_name ORDER BY ctr DESC NULLS FIRST, impressions DESC) AS ctr_rank_in_interaction FROM (SELECT interaction_name, left_feature_name, left_feature_value, right_feature_name, right_feature_value, {ADD} FROM b_inter GROUP BY ALL)"
# --- ranked ---
AGAINST = "o.overall_ctr, round(x.ctr - o.overall_ctr, 6) AS ctr_lift_vs_overall"
OF = "JOIN (SELECT batch_id, ctr AS overall_ctr FROM b_overall) o USING (batch_id)"
BEST = "ctr DESC NULLS FIRST, impressions DESC"
VIEWS["r_feature"] = f"""SELECT *, row_number() OVER (PARTITION BY batch_id, feature_name ORDER BY {BEST}, feature_value) AS row_number_in_feature,
 dense_rank() OVER (PARTITION BY batch_id, feature_name ORDER BY {BEST}) AS dense_rank_in_feature,
 round(percent_rank() OVER (PARTITION BY batch_id, feature_name ORDER BY ctr ASC NULLS LAST), 6) AS percent_rank_in_feature,
 ntile(4) OVER (PARTITION BY batch_id, feature_name ORDER BY {BEST}, feature_value) AS ctr_quartile_in_feature
 FROM (SELECT x.*, {AGAINST}, {band('impressions', HIGH, MEDIUM)} AS volume_band FROM b_feature x {OF})"""
W3 = "(PARTITION BY batch_id, event_batch ORDER BY event_day_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
W0 = "(PARTITION BY batch_id, event_batch ORDER BY event_day_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WD = "(PARTITION BY batch_id, event_batch ORDER BY event_day_number)"
VIEWS["r_rolling"] = f"""SELECT *, lag(ctr) OVER {WD} AS previous_day_ctr, round(ctr - lag(ctr) OVER {WD}, 6) AS ctr_change_from_previous_day,
 CAST(sum(impressions) OVER {W0} AS BIGINT) AS cumulative_impressions, CAST(sum(clicks) OVER {W0} AS BIGINT) AS cumulative_clicks,
 {ratio(f'sum(clicks) OVER {W0}', f'sum(impressions) OVER {W0}')} AS cumulative_ctr, round(avg(ctr) OVER {W3}, 6) AS rolling_3_day_avg_ctr,
 {ratio(f'sum(clicks) OVER {W3}', f'sum(impressions) OVER {W3}')} AS rolling_3_day_weighted_ctr FROM b_day"""
VIEWS["segments"] = f"""SELECT x.*, {AGAINST} FROM (
 SELECT batch_id, 'categorical_feature_value' AS segment_type, feature_name AS segment_name, feature_value AS segment_value, impressions, clicks, ctr, {band('impressions', HIGH, MEDIUM)} AS volume_band FROM b_feature
 UNION ALL SELECT batch_id, 'numeric_feature_bucket', feature_name, bucket_label, impressions, clicks, ctr, {band('impressions', HIGH, MEDIUM_BUCKET)} FROM b_bucket
 UNION ALL SELECT batch_id, 'feature_interaction', interaction_name, left_feature_value || ' x ' || right_feature_value, impressions, clicks, ctr, {band('impressions', HIGH, MEDIUM)} FROM b_inter) x {OF}"""
LEAST, LEAST_PAIR = 200, 50
VIEWS["r_high"] = f"SELECT *, dense_rank() OVER (PARTITION BY batch_id, segment_type ORDER BY ctr_lift_vs_overall DESC, impressions DESC) AS segment_rank_by_lift, dense_rank() OVER (PARTITION BY batch_id, segment_type ORDER BY clicks DESC, impressions DESC) AS segment_rank_by_clicks FROM segments WHERE impressions >= CASE WHEN segment_type = 'feature_interaction' THEN {LEAST_PAIR} ELSE {LEAST} END AND ctr_lift_vs_overall > 0.05"
VIEWS["r_low"] = f"SELECT *, dense_rank() OVER (PARTITION BY batch_id, segment_type ORDER BY ctr_lift_vs_overall ASC, impressions DESC) AS segment_rank_by_underperformance, dense_rank() OVER (PARTITION BY batch_id, segment_type ORDER BY impressions DESC, clicks ASC) AS segment_rank_by_volume FROM segments WHERE impressions >= CASE WHEN segment_type = 'feature_interaction' THEN {LEAST_PAIR} ELSE {LEAST} END AND ctr_lift_vs_overall < CASE WHEN segment_type = 'feature_interaction' THEN -0.02 ELSE -0.05 END"
VIEWS["r_lift"] = f"""SELECT *, row_number() OVER (PARTITION BY batch_id, feature_family, feature_name ORDER BY ctr_lift_vs_overall DESC NULLS FIRST, impressions DESC, segment_value) AS row_number_by_lift,
 dense_rank() OVER (PARTITION BY batch_id, feature_family, feature_name ORDER BY ctr_lift_vs_overall DESC NULLS FIRST, impressions DESC) AS dense_rank_by_lift,
 ntile(5) OVER (PARTITION BY batch_id, feature_family ORDER BY ctr_lift_vs_overall DESC NULLS FIRST, impressions DESC, feature_name, segment_value) AS lift_quintile FROM (SELECT x.*, {AGAINST} FROM (
 SELECT batch_id, 'categorical_feature' AS feature_family, feature_name, feature_value AS segment_value, impressions, clicks, ctr, {band('impressions', HIGH, MEDIUM)} AS volume_band FROM b_feature
 UNION ALL SELECT batch_id, 'numeric_bucket', feature_name, bucket_label, impressions, clicks, ctr, {band('impressions', HIGH, MEDIUM_BUCKET)} FROM b_bucket) x {OF})"""
VIEWS["r_inter"] = f"""SELECT *, row_number() OVER (PARTITION BY batch_id, interaction_name ORDER BY {BEST}, left_feature_value, right_feature_value) AS row_number_in_interaction,
 dense_rank() OVER (PARTITION BY batch_id, interaction_name ORDER BY {BEST}) AS dense_rank_in_interaction,
 round(percent_rank() OVER (PARTITION BY batch_id, interaction_name ORDER BY ctr ASC NULLS LAST), 6) AS percent_rank_in_interaction,
 CAST(sum(clicks) OVER (PARTITION BY batch_id, interaction_name ORDER BY clicks DESC, impressions DESC, left_feature_value, right_feature_value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_clicks_by_interaction
 FROM (SELECT x.*, {AGAINST}, {band('impressions', HIGH, MEDIUM)} AS volume_band FROM b_inter x {OF})"""
# --- features ---
CODED = _join(f"{bucket(c)} AS {c}_bucket_code" for c in NUMERIC)
VIEWS["store0"] = f"""SELECT raw_event_id, batch_id, label, event_day_number, event_batch, click_flag, impression_count, click_count, missing_numeric_count, missing_categorical_count,
 CAST(missing_numeric_count > 0 AS INT) AS has_missing_numeric, CAST(missing_categorical_count > 0 AS INT) AS has_missing_categorical, CAST(missing_numeric_count + missing_categorical_count >= 5 AS INT) AS high_missingness_flag,
 {_join(NUMERIC)}, {_join(f"ln(1 + greatest({c}, 0)) AS {c}_log_scale" for c in NUMERIC)}, {_join(STORED)}, {CODED} FROM stg"""
VIEWS["store"] = f"""SELECT b.*, {_join(f"coalesce(n_{c}.ctr_lift_vs_overall, 0) AS {c}_bucket_ctr_lift" for c in NUMERIC)}, {_join(f"coalesce(f_{c}.ctr_lift_vs_overall, 0) AS {c}_ctr_lift" for c in STORED)},
 {_join(f"CAST(coalesce(f_{c}.impressions, 0) AS BIGINT) AS {c}_feature_impressions" for c in STORED)}, (SELECT ctr FROM m_overall) AS overall_ctr FROM store0 b
 {_join((f"LEFT JOIN m_bucket n_{c} ON n_{c}.feature_name = '{c}' AND n_{c}.bucket_code = b.{c}_bucket_code" for c in NUMERIC), " ")}
 {_join((f"LEFT JOIN m_feature f_{c} ON f_{c}.feature_name = '{c}' AND f_{c}.feature_value = b.{c}" for c in STORED), " ")}"""
VIEWS["split"] = "SELECT *, CASE WHEN event_day_number <= 5 THEN 'train' WHEN event_day_number = 6 THEN 'validation' ELSE 'test' END AS dataset_split FROM store"
ENCODED = [*STORED, *(f"{c}_bucket_code" for c in NUMERIC)]
TRAIN_LONG = _join((f"SELECT '{c}' AS column_name, {c} AS value, label FROM split WHERE dataset_split = 'train'" for c in ENCODED), " UNION ALL ")
VIEWS["g"] = "SELECT avg(label) AS global_ctr, count(*) AS train_rows FROM split WHERE dataset_split = 'train'"
VIEWS["enc"] = f"SELECT column_name, value, (sum(label) + (SELECT global_ctr FROM g) * CAST(50 AS DOUBLE)) / (count(*) + CAST(50 AS DOUBLE)) AS smoothed_ctr, count(*) / (SELECT train_rows FROM g) AS frequency, ln(1 + count(*)) AS log_count FROM ({TRAIN_LONG}) GROUP BY column_name, value"
ENC = _join(f"coalesce(e_{c}.smoothed_ctr, (SELECT global_ctr FROM g)) AS {c}_enc_ctr, coalesce(e_{c}.smoothed_ctr, (SELECT global_ctr FROM g)) - (SELECT global_ctr FROM g) AS {c}_enc_ctr_lift, coalesce(e_{c}.log_count, 0) AS {c}_enc_log_count" for c in ENCODED)
VIEWS["encoded"] = f"SELECT s.*, {ENC} FROM split s {_join((f'LEFT JOIN enc e_{c} ON e_{c}.column_name = {chr(39)}{c}{chr(39)} AND e_{c}.value = s.{c}' for c in ENCODED), ' ')}"
BL = [f"{c}_bucket_ctr_lift" for c in NUMERIC]
VL = [f"{c}_ctr_lift" for c in STORED]
SL = [f"ln(1 + greatest({c}_feature_impressions, 0))" for c in STORED]
LG = [f"{c}_log_scale" for c in NUMERIC]
plus = lambda xs: "(" + " + ".join(xs) + ")"
AGGS = {
    "bucket_lift_sum": plus(BL), "bucket_lift_mean": f"{plus(BL)} / 13", "bucket_lift_max": f"greatest({_join(BL)})",
    "bucket_lift_positive_count": plus([f"CAST({c} > 0 AS INT)" for c in BL]), "bucket_lift_negative_count": plus([f"CAST({c} < 0 AS INT)" for c in BL]),
    "categorical_lift_sum": plus(VL), "categorical_lift_mean": f"{plus(VL)} / 7", "categorical_lift_max": f"greatest({_join(VL)})",
    "categorical_support_log_sum": plus(SL), "categorical_support_log_mean": f"{plus(SL)} / 7",
    "numeric_log_sum": plus(LG), "numeric_log_mean": f"{plus(LG)} / 13", "numeric_log_max": f"greatest({_join(LG)})",
    "total_missing_count": "missing_numeric_count + missing_categorical_count", "missing_ratio": "(missing_numeric_count + missing_categorical_count) / 39",
    "event_day_x_bucket_lift_mean": f"event_day_number * {plus(BL)} / 13", "high_missing_x_bucket_lift_mean": f"high_missingness_flag * {plus(BL)} / 13",
    "missing_ratio_x_categorical_lift_mean": f"(missing_numeric_count + missing_categorical_count) / 39 * {plus(VL)} / 7",
}
# --- operations ---
VIEWS["reg"] = """SELECT batch_id, concat('batch_', CAST(batch_id AS VARCHAR)) AS batch_name, concat('events_', CAST(batch_id % 5 AS VARCHAR), '.csv') AS source_file,
 CASE WHEN batch_id % 2 = 0 THEN 'incoming' ELSE 'sample' END AS source_type, CASE batch_id % 3 WHEN 0 THEN '100k' WHEN 1 THEN '1m' ELSE '5m' END AS sample_scale,
 CASE WHEN batch_id % 7 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS batch_status, expected_row_count, created_at, CASE WHEN batch_id % 7 = 0 THEN NULL ELSE last END AS completed_at,
 concat('run_', CAST(batch_id AS VARCHAR)) AS orchestration_run_id FROM (SELECT CAST(day(ts) AS BIGINT) AS batch_id, count(*) AS expected_row_count, min(ts) AS created_at, max(ts) AS last FROM events GROUP BY 1)"""
LAYERS = "['raw', 'staging', 'warehouse', 'marts', 'feature_store']"
VIEWS["runs"] = f"SELECT o_orderkey AS pipeline_run_id, o_custkey % 30 + 1 AS batch_id, {LAYERS}[o_orderkey % 5 + 1] AS layer_name, o_orderpriority AS pipeline_name, CASE o_orderstatus WHEN 'O' THEN 'SUCCESS' WHEN 'F' THEN 'FAILED' ELSE 'RUNNING' END AS run_status, CAST(o_orderdate AS DATE) AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 900 AS DOUBLE) END AS duration_seconds FROM orders"
VIEWS["steps"] = "SELECT l_orderkey AS pipeline_run_id, CASE l_returnflag WHEN 'R' THEN 'SUCCESS' WHEN 'A' THEN 'FAILED' ELSE 'RUNNING' END AS step_status FROM lineitem"
VIEWS["snaps"] = f"""SELECT o_orderkey AS benchmark_id, o_custkey % 30 + 1 AS batch_id, ['pipeline_stage_runtime', 'table_storage', 'file_storage'][o_orderkey % 3 + 1] AS benchmark_name,
 CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 'source' ELSE 'processed' END ELSE {LAYERS}[(o_orderkey // 3) % 5 + 1] END AS layer_name,
 concat('object_', CAST((o_orderkey // 15) % 2 AS VARCHAR)) AS object_name, o_orderkey % 5000 AS row_count, CAST(o_orderkey % 900 AS DOUBLE) AS duration_seconds,
 CASE WHEN o_orderkey % 900 > 0 THEN round((o_orderkey % 5000) / (o_orderkey % 900), 3) END AS rows_per_second, round(o_totalprice / 1000, 3) AS storage_mb, CAST(o_orderdate AS DATE) AS recorded_at FROM orders"""
VIEWS["vres"] = "SELECT event_id AS validation_id, CAST(day(ts) AS BIGINT) AS run_id, concat('layer_', CAST(user_id % 5 AS VARCHAR)) AS layer_name, concat('chk_', CAST(event_id % 26 AS VARCHAR)) AS check_name, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'WARN' ELSE 'PASS' END AS check_status, CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, ts AS checked_at FROM events"
VIEWS["vruns"] = "SELECT run_id, run_id AS batch_id, 'quality' AS pipeline_name, CASE WHEN run_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS run_status, started_at, completed_at FROM (SELECT CAST(day(ts) AS BIGINT) AS run_id, min(ts) AS started_at, max(ts) AS completed_at FROM events GROUP BY 1)"
VIEWS["alerts"] = "SELECT event_id AS alert_id, CAST(day(ts) AS BIGINT) AS batch_id, CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'warning' END AS alert_level, CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('run_', CAST(day(ts) AS VARCHAR)) END AS alert_run_id FROM events WHERE event_type = 'error'"


def newest(table: str, keys: str, order: str) -> str:
    return f"SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rk FROM {table}) WHERE rk = 1"


VIEWS["bench"] = f"SELECT s.*, r.batch_name, r.sample_scale FROM ({newest('snaps', 'batch_id, benchmark_name, layer_name, object_name', 'recorded_at DESC, benchmark_id DESC')}) s JOIN reg r USING (batch_id)"
VIEWS["runsum"] = "SELECT r.pipeline_run_id, r.batch_id, b.batch_name, r.pipeline_name, r.layer_name, r.run_status, r.started_at, r.duration_seconds, count(s.step_status) AS total_steps, count(*) FILTER (WHERE s.step_status = 'SUCCESS') AS successful_steps, count(*) FILTER (WHERE s.step_status = 'FAILED') AS failed_steps FROM runs r JOIN reg b USING (batch_id) LEFT JOIN steps s USING (pipeline_run_id) GROUP BY ALL"
AS_OF = "2024-02-15 00:00:00"
VIEWS["health"] = f"""SELECT b.*, round((epoch_us(coalesce(b.completed_at, TIMESTAMP '{AS_OF}')) - epoch_us(b.created_at)) / 1e6, 3) AS batch_elapsed_seconds,
 q.run_id AS latest_quality_run_id, q.run_status AS latest_quality_run_status, {_join(f"coalesce({c}, 0) AS {c}" for c in ("total_quality_checks", "passed_quality_checks", "warning_quality_checks", "failed_quality_checks", "total_alerts", "error_alerts", "warning_alerts"))},
 round(coalesce(t.total, 0), 3) AS total_stage_runtime_seconds, round(coalesce(t.slowest, 0), 3) AS slowest_stage_runtime_seconds FROM reg b
 LEFT JOIN (SELECT v.batch_id, v.run_id, v.run_status, count(*) AS total_quality_checks, count(*) FILTER (WHERE check_status = 'PASS') AS passed_quality_checks, count(*) FILTER (WHERE check_status = 'WARN') AS warning_quality_checks, count(*) FILTER (WHERE check_status = 'FAIL') AS failed_quality_checks
   FROM ({newest('vruns', 'batch_id', 'started_at DESC, run_id DESC')}) v JOIN vres USING (run_id) GROUP BY ALL) q USING (batch_id)
 LEFT JOIN (SELECT a.batch_id, count(*) AS total_alerts, count(*) FILTER (WHERE alert_level = 'error') AS error_alerts, count(*) FILTER (WHERE alert_level = 'warning') AS warning_alerts FROM alerts a JOIN reg r ON a.batch_id = r.batch_id AND a.alert_run_id = r.orchestration_run_id GROUP BY ALL) a USING (batch_id)
 LEFT JOIN (SELECT batch_id, sum(duration_seconds) AS total, max(duration_seconds) AS slowest FROM bench WHERE benchmark_name = 'pipeline_stage_runtime' GROUP BY ALL) t USING (batch_id)"""
VIEWS["trend"] = "SELECT batch_id, batch_name, sample_scale, layer_name, object_name, duration_seconds, rows_per_second, row_count, storage_mb, recorded_at FROM bench WHERE benchmark_name = 'pipeline_stage_runtime'"
VIEWS["storage"] = "SELECT batch_id, max(storage_mb) FILTER (WHERE benchmark_name = 'file_storage' AND layer_name = 'source') AS sample_file_size_mb, round(sum(storage_mb) FILTER (WHERE benchmark_name = 'file_storage' AND layer_name = 'processed'), 3) AS processed_artifact_size_mb, " + _join(f"max(storage_mb) FILTER (WHERE benchmark_name = 'table_storage' AND layer_name = '{x}') AS {x}_table_size_mb" for x in ("raw", "staging", "warehouse", "feature_store")) + " FROM bench GROUP BY batch_id"
VIEWS["base"] = f"""SELECT h.*, f.ctr, f.avg_missing_numeric_count, f.avg_missing_categorical_count, s.* EXCLUDE (batch_id), coalesce(f.n, 0) AS fact_rows, coalesce(f.c, 0) AS clicks FROM health h
 LEFT JOIN (SELECT batch_id, count(*) AS n, CAST(sum(click_count) AS BIGINT) AS c, {ratio('sum(click_count)', 'count(*)')} AS ctr, {AVGS} FROM fact GROUP BY batch_id) f USING (batch_id) LEFT JOIN storage s USING (batch_id)"""
BEFORE = ["batch_id", "batch_name", "fact_rows", "ctr", "avg_missing_numeric_count", "avg_missing_categorical_count", "total_stage_runtime_seconds", "total_quality_checks", "failed_quality_checks", "total_alerts", "sample_file_size_mb"]
WB = "(PARTITION BY source_type, sample_scale ORDER BY batch_id)"


def delta_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {b} = 0 THEN NULL ELSE round(({a} - {b}) / {b}, 6) END"


VIEWS["drift"] = f"""SELECT *, fact_rows - previous_fact_rows AS fact_row_delta, {delta_ratio('fact_rows', 'previous_fact_rows')} AS fact_row_delta_ratio, round(ctr - previous_ctr, 6) AS ctr_delta,
 round(avg_missing_numeric_count - previous_avg_missing_numeric_count, 6) AS avg_missing_numeric_delta, round(avg_missing_categorical_count - previous_avg_missing_categorical_count, 6) AS avg_missing_categorical_delta,
 round(total_stage_runtime_seconds - previous_total_stage_runtime_seconds, 3) AS runtime_delta_seconds, {delta_ratio('total_stage_runtime_seconds', 'previous_total_stage_runtime_seconds')} AS runtime_delta_ratio,
 failed_quality_checks - previous_failed_quality_checks AS failed_quality_delta, total_alerts - previous_total_alerts AS alert_delta, round(sample_file_size_mb - previous_sample_file_size_mb, 3) AS sample_file_size_delta_mb,
 CASE WHEN previous_batch_id IS NULL THEN 'baseline' WHEN failed_quality_checks > coalesce(previous_failed_quality_checks, 0) THEN 'quality_regression' WHEN total_alerts > coalesce(previous_total_alerts, 0) THEN 'alert_regression'
  WHEN abs(ctr - previous_ctr) >= 0.05 THEN 'ctr_shift' WHEN abs(avg_missing_categorical_count - previous_avg_missing_categorical_count) >= 0.5 THEN 'missingness_shift'
  WHEN previous_total_stage_runtime_seconds > 0 AND (total_stage_runtime_seconds - previous_total_stage_runtime_seconds) / previous_total_stage_runtime_seconds >= 0.5 THEN 'runtime_regression' ELSE 'stable' END AS drift_status
 FROM (SELECT batch_id, batch_name, source_type, sample_scale, {_join(BEFORE[2:])}, {_join(f"lag({c}) OVER {WB} AS previous_{c}" for c in BEFORE)} FROM base)"""
# --- models ---
VIEWS["models"] = "SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 4 = 0 THEN 'ctr_logistic_regression' ELSE concat('model_', CAST(s_suppkey % 4 AS VARCHAR)) END AS model_name, concat('v', CAST(s_suppkey AS VARCHAR)) AS model_version, CASE WHEN s_suppkey % 5 = 4 THEN 'TRAINING' ELSE 'READY' END AS model_status, s_suppkey < 4 AS is_active_canonical, CASE WHEN s_suppkey < 4 THEN DATE '2024-01-01' END AS canonical_promoted_at, CASE WHEN s_suppkey < 4 THEN concat('note ', CAST(s_suppkey AS VARCHAR)) END AS canonical_promotion_note FROM supplier"
VIEWS["truns"] = "SELECT o_orderkey AS training_run_id, o_custkey % 10 AS model_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS run_status, CASE WHEN o_orderkey % 17 = 0 THEN 'canonical_1m_batch' ELSE concat('batch_', CAST(o_custkey % 30 + 1 AS VARCHAR)) END AS train_batch_name, o_orderkey * 37 % 900000 AS rows_trained, o_orderkey * 7 % 90000 AS rows_validated, o_orderkey * 5 % 90000 AS rows_tested, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS completed_at FROM orders"


def metric(base: str, k: int, n: int, by: str) -> str:
    return f"CAST({base} AS DOUBLE) + (o_orderkey * (k + {k}) % {n}) / CAST({by} AS DOUBLE)"


VIEWS["tmetrics"] = f"SELECT o_orderkey * 3 + k AS metric_id, o_orderkey AS training_run_id, ['train', 'validation', 'test'][k + 1] AS dataset_split, CASE WHEN k <> 1 OR o_orderkey % 23 <> 0 THEN {metric('0.5', 7, 4000, '10000')} END AS roc_auc, {metric('0.2', 11, 5000, '10000')} AS pr_auc, {metric('0.3', 13, 6000, '10000')} AS log_loss, {metric('0.1', 17, 7000, '10000')} AS precision_at_10pct, {metric('1', 19, 2000, '1000')} AS lift_at_10pct, CAST(o_orderdate AS DATE) AS recorded_at FROM orders, range(3) t(k)"
VIEWS["scores0"] = "SELECT event_id AS raw_event_id, CAST(day(ts) AS BIGINT) AS batch_id, m AS model_id, CAST(event_type = 'click' AS INT) AS actual_click, round(least(1, greatest(0, 0.05e0 + 0.3e0 * CAST(event_type = 'click' AS INT) + ((event_id * 37 + user_id * 11 * m) % 1000) / 2000e0)), 6) AS predicted_ctr FROM events, range(1, 4) t(m)"
VIEWS["scores1"] = "SELECT s.*, r.model_name, r.model_version, t.training_run_id FROM scores0 s JOIN models r USING (model_id) JOIN (SELECT model_id, max(training_run_id) AS training_run_id FROM truns WHERE run_status = 'SUCCESS' GROUP BY 1) t USING (model_id)"
VIEWS["scores"] = "SELECT * EXCLUDE (r0, n), CAST(10 - least(9, (r0 * 10) // n) AS INT) AS score_decile, 10 - least(9, (r0 * 10) // n) = 10 AS is_top_decile FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, model_id ORDER BY predicted_ctr DESC, raw_event_id) - 1 AS r0, count(*) OVER (PARTITION BY batch_id, model_id) AS n FROM scores1)"
IDS = "batch_id, model_id, training_run_id, model_name, model_version"
VIEWS["perf0"] = f"SELECT {IDS}, count(*) AS rows_scored, round(avg(predicted_ctr), 6) AS overall_avg_predicted_ctr, round(avg(actual_click), 6) AS overall_actual_ctr, count(*) FILTER (WHERE is_top_decile) AS top_decile_rows, coalesce(round(avg(predicted_ctr) FILTER (WHERE is_top_decile), 6), 0) AS top_decile_avg_predicted_ctr, coalesce(round(avg(actual_click) FILTER (WHERE is_top_decile), 6), 0) AS top_decile_actual_ctr FROM scores GROUP BY ALL"
VIEWS["perf"] = "SELECT p.*, r.batch_name, CASE WHEN overall_actual_ctr <> 0 THEN round(top_decile_actual_ctr / overall_actual_ctr, 6) END AS top_decile_lift_vs_batch_ctr, round(top_decile_avg_predicted_ctr - overall_avg_predicted_ctr, 6) AS top_decile_predicted_ctr_gap, round(top_decile_actual_ctr - overall_actual_ctr, 6) AS top_decile_actual_ctr_gap FROM perf0 p JOIN reg r USING (batch_id)"
WM = "(PARTITION BY model_name, model_version ORDER BY batch_id)"
LAGS = {"batch_id": "previous_batch_id", "batch_name": "previous_batch_name", "overall_avg_predicted_ctr": "previous_avg_predicted_ctr", "overall_actual_ctr": "previous_actual_ctr", "top_decile_actual_ctr": "previous_top_decile_actual_ctr", "top_decile_lift_vs_batch_ctr": "previous_top_decile_lift"}
VIEWS["sdrift"] = f"SELECT *, round(overall_avg_predicted_ctr - previous_avg_predicted_ctr, 6) AS avg_predicted_ctr_delta, round(overall_actual_ctr - previous_actual_ctr, 6) AS actual_ctr_delta, round(top_decile_actual_ctr - previous_top_decile_actual_ctr, 6) AS top_decile_actual_ctr_delta, round(top_decile_lift_vs_batch_ctr - previous_top_decile_lift, 6) AS top_decile_lift_delta FROM (SELECT * EXCLUDE (top_decile_predicted_ctr_gap, top_decile_actual_ctr_gap), {_join(f'lag({a}) OVER {WM} AS {b}' for a, b in LAGS.items())} FROM perf)"
PIVOT = {"train": ["roc_auc", "pr_auc", "log_loss"], "validation": ["roc_auc", "pr_auc", "log_loss", "precision_at_10pct", "lift_at_10pct"], "test": ["roc_auc", "pr_auc", "log_loss", "precision_at_10pct", "lift_at_10pct"]}
VIEWS["mpivot"] = "SELECT model_name, model_version, training_run_id, train_batch_name, rows_trained, rows_validated, rows_tested, " + _join(f"max(CASE WHEN dataset_split = '{s}' THEN {m} END) AS {s}_{m}" for s, ms in PIVOT.items() for m in ms) + " FROM models JOIN truns USING (model_id) JOIN tmetrics USING (training_run_id) GROUP BY ALL"
VIEWS["mcomp"] = """SELECT p.*, CASE WHEN train_batch_name = 'canonical_1m_batch' OR rows_trained >= 500000 THEN 'large_scale' WHEN rows_trained >= 100000 THEN 'medium_scale' ELSE 'small_scale' END AS training_scale_band, train_batch_name = 'canonical_1m_batch' AS is_canonical_1m_run,
 CASE WHEN train_batch_name = 'canonical_1m_batch' AND model_name = 'ctr_logistic_regression' THEN 'Canonical 1M logistic baseline.' WHEN rows_trained < 1000 THEN 'Small-batch prototype; useful for experimentation, not the main benchmark claim.' ELSE 'Experimental comparison run.' END AS comparison_note,
 s.batch_name AS scored_batch_name, s.rows_scored, s.overall_actual_ctr, s.top_decile_actual_ctr, s.top_decile_lift_vs_batch_ctr, s.top_decile_avg_predicted_ctr FROM mpivot p LEFT JOIN perf s USING (model_name, model_version, training_run_id)"""
VIEWS["active"] = "SELECT a.model_name, a.model_version, a.model_id, a.canonical_promoted_at, a.canonical_promotion_note, c.training_run_id, c.train_batch_name, c.rows_trained, c.validation_roc_auc, c.validation_pr_auc, c.validation_log_loss, c.validation_precision_at_10pct, c.validation_lift_at_10pct, c.test_roc_auc, c.test_pr_auc, c.test_log_loss, c.top_decile_lift_vs_batch_ctr FROM models a LEFT JOIN (SELECT model_id, max(training_run_id) AS run FROM truns WHERE run_status = 'SUCCESS' GROUP BY 1) t USING (model_id) LEFT JOIN mcomp c ON c.model_name = a.model_name AND c.model_version = a.model_version AND c.training_run_id = t.run WHERE a.is_active_canonical"
# The active model's row is repeated for each batch it scored; the dashboard takes one.
VIEWS["active1"] = "SELECT DISTINCT model_name, model_version, model_id, canonical_promoted_at, canonical_promotion_note, training_run_id, validation_roc_auc, validation_pr_auc, validation_lift_at_10pct FROM active"
VIEWS["dash"] = f"""SELECT *, CASE WHEN is_active_canonical THEN 'active' WHEN active_validation_roc_auc IS NULL THEN 'no_active_reference' WHEN promotion_roc_auc_gap >= 0.005e0 AND promotion_pr_auc_gap >= 0.005e0 AND promotion_lift_gap >= 0.05e0 THEN 'eligible' ELSE 'not_eligible' END AS promotion_status,
 CASE WHEN validation_roc_auc >= 0.7e0 THEN 'strong' WHEN validation_roc_auc >= 0.6e0 THEN 'good' WHEN validation_roc_auc >= 0.55e0 THEN 'watch' ELSE 'weak' END AS validation_quality_band,
 CASE WHEN coalesce(top_decile_lift_vs_batch_ctr, 0) >= 2 THEN 'strong' WHEN coalesce(top_decile_lift_vs_batch_ctr, 0) >= 1.5 THEN 'good' WHEN coalesce(top_decile_lift_vs_batch_ctr, 0) >= 1.2 THEN 'watch' ELSE 'weak' END AS ranking_quality_band,
 CASE WHEN abs(coalesce(top_decile_lift_delta, 0)) >= 0.5 THEN 'high' WHEN abs(coalesce(top_decile_lift_delta, 0)) >= 0.2 THEN 'medium' ELSE 'low' END AS drift_severity FROM (
 SELECT r.model_name, r.model_version, r.training_run_id, r.train_batch_name, r.rows_trained, r.rows_validated, r.rows_tested, r.training_scale_band, r.is_canonical_1m_run, r.comparison_note, {_join(f'r.{s}_{m}' for s in ('validation', 'test') for m in PIVOT[s])},
  p.batch_id AS latest_scored_batch_id, p.batch_name AS latest_scored_batch_name, p.rows_scored, p.overall_avg_predicted_ctr, p.overall_actual_ctr, p.top_decile_rows, p.top_decile_avg_predicted_ctr, p.top_decile_actual_ctr, p.top_decile_lift_vs_batch_ctr, p.top_decile_predicted_ctr_gap, p.top_decile_actual_ctr_gap,
  d.previous_batch_id, d.previous_batch_name, d.avg_predicted_ctr_delta, d.actual_ctr_delta, d.top_decile_actual_ctr_delta, d.top_decile_lift_delta, o.canonical_promotion_note,
  a.validation_roc_auc AS active_validation_roc_auc, a.validation_pr_auc AS active_validation_pr_auc, a.validation_lift_at_10pct AS active_validation_lift_at_10pct, o.model_id IS NOT NULL AS is_active_canonical,
  round(r.validation_roc_auc - a.validation_roc_auc, 6) AS promotion_roc_auc_gap, round(r.validation_pr_auc - a.validation_pr_auc, 6) AS promotion_pr_auc_gap, round(r.validation_lift_at_10pct - a.validation_lift_at_10pct, 6) AS promotion_lift_gap
 FROM ({newest('mcomp', 'model_name, model_version', 'training_run_id DESC NULLS FIRST, scored_batch_name DESC NULLS FIRST')}) r
 LEFT JOIN active1 o ON o.model_name = r.model_name AND o.model_version = r.model_version AND o.training_run_id = r.training_run_id
 LEFT JOIN ({newest('perf', 'model_name, model_version', 'batch_id DESC')}) p ON p.model_name = r.model_name AND p.model_version = r.model_version AND p.training_run_id = r.training_run_id
 LEFT JOIN ({newest('sdrift', 'model_name, model_version', 'batch_id DESC')}) d ON d.model_name = r.model_name AND d.model_version = r.model_version AND d.batch_id = p.batch_id
 LEFT JOIN active1 a ON a.model_name = r.model_name)"""
MOVED, SHIFT = "abs(coalesce(top_decile_lift_delta, 0))", "abs(coalesce(actual_ctr_delta, 0))"
VIEWS["watch"] = f"""SELECT {IDS}, batch_name, previous_batch_id, previous_batch_name, overall_avg_predicted_ctr, overall_actual_ctr, top_decile_actual_ctr, top_decile_lift_vs_batch_ctr, avg_predicted_ctr_delta, actual_ctr_delta, top_decile_actual_ctr_delta, top_decile_lift_delta,
 CASE WHEN previous_batch_id IS NULL THEN 'baseline' WHEN {MOVED} >= 0.5 OR {SHIFT} >= 0.05 THEN 'investigate' WHEN {MOVED} >= 0.2 OR {SHIFT} >= 0.02 THEN 'watch' ELSE 'stable' END AS drift_status,
 CASE WHEN previous_batch_id IS NULL THEN 'No previous scored batch for comparison.' WHEN {MOVED} >= 0.5 THEN 'Top-decile lift changed materially from the previous batch.' WHEN {SHIFT} >= 0.05 THEN 'Observed batch CTR shifted materially from the previous batch.' WHEN {MOVED} >= 0.2 THEN 'Top-decile lift moved enough to deserve review.' WHEN {SHIFT} >= 0.02 THEN 'Observed CTR moved enough to deserve review.' ELSE 'No material drift detected.' END AS drift_note FROM sdrift"""
NAMES = "[" + _join(f"'{f}'" for f in FEATURES) + "]"
VIEWS["coef"] = f"SELECT p_partkey % 4 AS model_id, (p_partkey // 4) % 2 AS training_run_id, concat({NAMES}[(p_partkey // 8) % {len(FEATURES)} + 1], CASE WHEN p_partkey // 8 >= {len(FEATURES)} THEN concat('_', CAST(p_partkey // 8 AS VARCHAR)) ELSE '' END) AS feature_name, round((p_partkey * 7919 % 2001 - 1000) / 1000e0, 6) AS importance_value FROM part"
GROUPS = """CASE WHEN contains(feature_name, 'missing') THEN 'missingness' WHEN feature_name IN ('event_day_number', 'overall_ctr') THEN 'context' WHEN feature_name LIKE 'i%' AND feature_name LIKE '%\\_log\\_scale' ESCAPE '\\' THEN 'numeric_log' WHEN regexp_full_match(feature_name, 'i[0-9]+') THEN 'numeric_raw'
 WHEN contains(feature_name, '_bucket_code_enc_') OR contains(feature_name, 'bucket_lift') OR ends_with(feature_name, '_bucket_ctr_lift') THEN 'bucket_signal' WHEN starts_with(feature_name, 'c') AND ends_with(feature_name, '_ctr_lift') THEN 'categorical_lift' WHEN contains(feature_name, 'support') OR ends_with(feature_name, '_log1p') THEN 'support_signal'
 WHEN contains(feature_name, '_enc_') THEN 'target_encoding' WHEN contains(feature_name, '_x_') THEN 'interaction' WHEN starts_with(feature_name, 'numeric_') THEN 'numeric_aggregate' WHEN starts_with(feature_name, 'categorical_') THEN 'categorical_aggregate' WHEN starts_with(feature_name, 'total_') OR ends_with(feature_name, '_ratio') THEN 'aggregate' ELSE 'other' END"""
VIEWS["imp0"] = f"""SELECT *, CASE WHEN importance_direction = 'positive' THEN 'Higher values of this feature push predicted CTR upward.' WHEN importance_direction = 'negative' THEN 'Higher values of this feature push predicted CTR downward.' ELSE 'This feature has a neutral coefficient in the latest fitted model.' END
 || CASE feature_group WHEN 'bucket_signal' THEN ' The model is using a bucket-derived historical or encoded signal.' WHEN 'categorical_lift' THEN ' This categorical lift feature reflects how a hashed value performed relative to baseline CTR.' WHEN 'target_encoding' THEN ' This encoded categorical feature summarizes historical click behavior for a sparse value.' WHEN 'numeric_log' THEN ' The model is reacting to the log-scaled magnitude of a numeric input.' WHEN 'support_signal' THEN ' This support feature reflects how frequently the categorical value appeared historically.' WHEN 'missingness' THEN ' Missing-value patterns are influencing expected click likelihood.' WHEN 'context' THEN ' This is a broad context feature rather than a specific sparse identity signal.' ELSE '' END AS interpretation_note,
 row_number() OVER (PARTITION BY model_id, training_run_id ORDER BY abs_importance_value DESC, feature_name) AS importance_rank
 FROM (SELECT *, abs(importance_value) AS abs_importance_value, round(coalesce(abs(importance_value) / nullif(sum(abs(importance_value)) OVER (PARTITION BY model_id, training_run_id), 0), 0), 6) AS relative_importance_pct,
  CASE WHEN importance_value > 0 THEN 'positive' WHEN importance_value < 0 THEN 'negative' ELSE 'neutral' END AS importance_direction, {GROUPS} AS feature_group FROM coef)"""
VIEWS["mimp"] = "SELECT i.*, m.model_name, m.model_version FROM imp0 i JOIN models m USING (model_id)"
VIEWS["limp"] = "SELECT i.* FROM mimp i JOIN (SELECT model_name, model_version, max(training_run_id) AS training_run_id FROM mimp GROUP BY 1, 2) USING (model_name, model_version, training_run_id)"
# --- evaluation ---
VIEWS["ev"] = "SELECT model_id, raw_event_id, predicted_ctr AS score, actual_click AS label FROM scores0"
VIEWS["byscore"] = "SELECT model_id, score, sum(label) AS pos, sum(1 - label) AS neg FROM ev GROUP BY ALL"
VIEWS["cum"] = "SELECT *, sum(pos) OVER (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(neg) OVER (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(pos) OVER (PARTITION BY model_id) AS tp, sum(neg) OVER (PARTITION BY model_id) AS tn FROM byscore"
EPS = "2.220446049250313e-16"
CLIP = f"least(greatest(score, {EPS}), 1 - {EPS})"
VIEWS["e_auc"] = "SELECT model_id, round(CAST(sum(pos * (tn - cn + neg / 2e0)) AS DOUBLE) / (max(tp) * max(tn)), 6) AS roc_auc FROM cum GROUP BY model_id"
VIEWS["e_ap"] = "SELECT model_id, round(CAST(sum(pos * (cp / CAST(cp + cn AS DOUBLE))) AS DOUBLE) / max(tp), 6) AS pr_auc FROM cum GROUP BY model_id"
VIEWS["e_loss"] = f"SELECT model_id, round(avg(-(label * ln({CLIP}) + (1 - label) * ln(1 - {CLIP}))), 6) AS log_loss, round(avg((score - label) * (score - label)), 6) AS brier_score FROM ev GROUP BY model_id"
VIEWS["e_top"] = "SELECT model_id, round(avg(label) FILTER (WHERE r < greatest(1, ceil(n * 0.1e0 - 1e-9))), 6) AS precision_at_10pct, round(coalesce(avg(label) FILTER (WHERE r < greatest(1, ceil(n * 0.1e0 - 1e-9))) / nullif(avg(label), 0), 0), 6) AS lift_at_10pct FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, raw_event_id) - 1 AS r, count(*) OVER (PARTITION BY model_id) AS n FROM ev) GROUP BY model_id"
VIEWS["e_all"] = "SELECT * FROM e_auc JOIN e_ap USING (model_id) JOIN e_loss USING (model_id) JOIN e_top USING (model_id)"


def sql(query: str) -> str:
    """The query with the views that it needs in front."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"(?:FROM|JOIN)\s+\(*{name}\b", text):
                need.add(name)
                visit(VIEWS[name])

    visit(query)
    heads = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in need]
    if not heads:
        return query
    if query.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(heads) + ",\n" + query.lstrip()[5:]
    return "WITH " + ",\n".join(heads) + "\n" + query
