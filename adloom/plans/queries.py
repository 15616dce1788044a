"""The registered queries: every operator on the driver's tables, and beside each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import CATEGORICAL, NUMERIC, STORED, source_schema
from adloom.operators import calibrate, evaluate, features, importance, incremental, marts, monitor, ops, promote, quality, ranked, sampling, staging, tables, train, warehouse
from adloom.plans import oracle as O
from adloom.sources import binding, files, keyed
from adloom.sources.work import compiled, saved, shared_dir

HIGH, MEDIUM, MEDIUM_BUCKET, LEAST, LEAST_PAIR = O.HIGH, O.MEDIUM, O.MEDIUM_BUCKET, O.LEAST, O.LEAST_PAIR
LOOKUP = features.split_lookup(features.parse_days("1,2,3,4,5"), features.parse_days("6"), features.parse_days("7"))


class Frames:
    """The tables of one scale, built when a query first asks for them. Staging, which many operators read, is
    written as a table, as the layers of a warehouse are, and so are the marts of batches. The split feature store isn't: each query goes through it once, and
    what encodings and days need of it is in `own_split`, without lookups."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.save = spark, sf_dir, saved
        compiled(spark)

    def of(self, read) -> DataFrame:
        return read(self.spark, self.dir)

    def path(self, name: str) -> str:
        import uuid

        return f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    imp = cached_property(lambda s: s.of(binding.impressions))
    stg = cached_property(lambda s: saved(staging.build(s.imp), "staging"))
    days = cached_property(lambda s: warehouse.dim_event_day(s.stg))
    fact = cached_property(lambda s: warehouse.fact_ad_events(s.stg, s.days))
    b_overall = cached_property(lambda s: saved(marts.batch_overall(s.fact), "b_overall"))
    b_day = cached_property(lambda s: saved(marts.batch_event_day(s.fact, s.days), "b_day"))
    d_bucket = cached_property(lambda s: saved(marts.day_buckets(s.stg), "d_bucket"))
    d_stored = cached_property(lambda s: saved(marts.day_values(s.stg, STORED), "d_stored"))
    b_bucket = cached_property(lambda s: saved(marts.bucket_sums(s.d_bucket), "b_bucket"))
    b_feature = cached_property(lambda s: saved(marts.batch_feature(s.stg), "b_feature"))
    b_missing = cached_property(lambda s: saved(marts.batch_missing(s.fact), "b_missing"))
    b_inter = cached_property(lambda s: saved(marts.batch_interactions(s.stg), "b_inter"))
    m_overall = cached_property(lambda s: marts.overall(s.b_overall))
    m_day = cached_property(lambda s: marts.event_day(s.b_day))
    m_bucket = cached_property(lambda s: marts.numeric_bucket(s.b_bucket, s.m_overall, HIGH, MEDIUM_BUCKET))
    m_feature = cached_property(lambda s: s.save(marts.feature(s.b_feature, s.m_overall, HIGH, MEDIUM), "m_feature"))
    m_missing = cached_property(lambda s: marts.missing(s.b_missing, s.m_overall))
    m_inter = cached_property(lambda s: s.save(marts.interactions(s.b_inter, s.m_overall, HIGH, MEDIUM), "m_inter"))
    r_feature = cached_property(lambda s: s.save(ranked.feature_ranked(s.b_feature, s.b_overall, HIGH, MEDIUM), "r_feature"))
    r_rolling = cached_property(lambda s: ranked.event_day_rolling(s.b_day))
    r_high = cached_property(lambda s: ranked.high_value_segments(s.b_feature, s.b_bucket, s.b_inter, s.b_overall, LEAST, LEAST_PAIR, 0.05, HIGH, MEDIUM, MEDIUM_BUCKET))
    r_low = cached_property(lambda s: ranked.low_performing_segments(s.b_feature, s.b_bucket, s.b_inter, s.b_overall, LEAST, LEAST_PAIR, -0.05, -0.02, HIGH, MEDIUM, MEDIUM_BUCKET))
    r_lift = cached_property(lambda s: s.save(ranked.lift_ranked(s.b_feature, s.b_bucket, s.b_overall, HIGH, MEDIUM, MEDIUM_BUCKET), "r_lift"))
    r_inter = cached_property(lambda s: s.save(ranked.interaction_ranked(s.b_inter, s.b_overall, HIGH, MEDIUM), "r_inter"))
    stored_lifts = cached_property(lambda s: marts.lifts(s.d_stored, s.m_overall))
    store = cached_property(lambda s: features.feature_store(s.stg, saved(s.m_bucket, "buckets"), s.stored_lifts, saved(s.m_overall, "overall")))
    split = cached_property(lambda s: features.with_split(s.store, LOOKUP))
    own_split = cached_property(lambda s: features.with_split(features.measured(s.stg), LOOKUP))
    train_rows = cached_property(lambda s: s.own_split.where("dataset_split = 'train'"))
    enc = cached_property(lambda s: saved(features.encodings(s.train_rows), "encodings"))
    total = cached_property(lambda s: saved(features.global_ctr(s.train_rows), "global"))
    learned = cached_property(lambda s: tuple(map(saved, features.encodings_of(*(features.with_split(d, LOOKUP).where("dataset_split = 'train'") for d in (s.d_bucket, s.d_stored))), ("encodings", "global"))))
    reg = cached_property(lambda s: s.of(binding.batch_registry))
    bench = cached_property(lambda s: ops.benchmark_summary(s.of(binding.benchmark_snapshots), s.reg))
    runsum = cached_property(lambda s: ops.run_summary(s.of(binding.pipeline_runs), s.reg, s.of(binding.pipeline_steps)))
    health = cached_property(lambda s: ops.health(s.reg, s.of(binding.validation_runs), s.of(binding.validation_results), s.of(binding.pipeline_alerts), s.bench, F.lit(O.AS_OF).cast("timestamp_ntz")))
    trend = cached_property(lambda s: ops.runtime_trend(s.bench))
    baseline = cached_property(lambda s: ops.metric_baseline(s.health, s.fact, s.bench))
    scores = cached_property(lambda s: evaluate.with_deciles(s.of(binding.named_scores), ["batch_id", "model_id"]))
    perf = cached_property(lambda s: saved(monitor.top_decile_performance(s.scores, s.reg), "perf"))
    sdrift = cached_property(lambda s: monitor.score_drift(s.perf))
    models = cached_property(lambda s: s.of(binding.model_registry))
    truns = cached_property(lambda s: s.of(binding.training_runs))
    tmetrics = cached_property(lambda s: s.of(binding.model_metrics))
    mcomp = cached_property(lambda s: saved(monitor.comparison(s.models, s.truns, s.tmetrics, s.perf), "mcomp"))
    active = cached_property(lambda s: saved(monitor.active_canonical(s.models, s.truns, s.mcomp), "active"))
    dash = cached_property(lambda s: monitor.latest_dashboard(s.mcomp, s.perf, s.sdrift, s.active.select("model_name", "model_version", "training_run_id", "canonical_promotion_note", "validation_roc_auc", "validation_pr_auc", "validation_lift_at_10pct").distinct()))
    watch = cached_property(lambda s: monitor.drift_watchlist(s.sdrift))
    coef = cached_property(lambda s: s.of(binding.coefficients))
    mimp = cached_property(lambda s: importance.importance(s.coef, ["model_id", "training_run_id"]).join(s.models.select("model_id", "model_name", "model_version"), "model_id"))
    limp = cached_property(lambda s: monitor.latest_importance(s.mimp))
    ev = cached_property(lambda s: s.of(binding.prediction_scores).select("model_id", "raw_event_id", F.col("predicted_ctr").alias("score"), F.col("actual_click").alias("label")))

    @cached_property
    def ml(self) -> tuple[DataFrame, list[str]]:
        """Engineered rows of all splits, and the names of the features."""
        keep = ["raw_event_id", "dataset_split", "label"]
        frame = features.engineered(self.split, *self.learned, keep)
        return saved(frame, "engineered"), [c for c in frame.columns if c not in keep]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, make: Callable[[Frames], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Frames(spark, sf_dir))
    if sql:
        ORACLE[name] = O.sql(sql)


J = ", ".join
STG = "raw_event_id, batch_id, label, " + J(NUMERIC) + ", " + J(CATEGORICAL) + ", event_day_number, event_batch, click_flag, impression_count, click_count, missing_numeric_count, missing_categorical_count, source_file, ingested_at"

# --- 2.1 sources, sinks, table maintenance ---
UPPER = J([*(f"{c} AS {c.upper()}" for c in NUMERIC), *(f"nullif({c}, '') AS {c.upper()}" for c in CATEGORICAL)])


def _file_rows(f: Frames) -> DataFrame:
    return f.imp.select("label", *(F.col(c).alias(c.upper()) for c in NUMERIC), *(F.nullif(F.col(c), F.lit("")).alias(c.upper()) for c in CATEGORICAL))


def _csv(f: Frames) -> DataFrame:
    path = f.path("csv")
    _file_rows(f).write.option("header", True).csv(path)
    return files.read_csv(f.spark, path)


def _tsv(f: Frames) -> DataFrame:
    path = f.path("tsv")
    _file_rows(f).write.option("sep", "\t").csv(path)
    return files.read_tsv(f.spark, path)


def _loaded(f: Frames) -> DataFrame:
    """Two batches of the same file: ids are unique over both and number the rows of each."""
    path = f.path("csv")
    _file_rows(f).write.option("header", True).csv(path)
    raw = None
    for batch in (7, 8):
        one = files.load_raw(files.read_csv(f.spark, path), batch, F.lit("2024-01-01").cast("timestamp"))
        raw = one if raw is None else raw.unionByName(one)
    raw = saved(raw, "raw")
    whole = raw.agg(F.countDistinct("event_id").alias("ids_in_all"))
    return raw.crossJoin(F.broadcast(whole)).groupBy("batch_id", "ids_in_all").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("event_id").alias("ids"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_if(F.col("c1").isNull()).alias("c1_null"), F.count_if(F.col("c1") == "").alias("c1_empty"), F.sum("label").alias("clicks"), F.count_if(F.col("source_file").endswith(".csv")).alias("named"))


add("s1_csv_scan", _csv, f"SELECT label, {UPPER} FROM imp")
add("s2_tsv_scan", _tsv, f"SELECT label, {UPPER} FROM imp")
add("s3_raw_load", _loaded, "SELECT CAST(b AS BIGINT) AS batch_id, 2 * count(*) AS ids_in_all, count(*) AS row_count, count(*) AS ids, CAST(b AS BIGINT) * 1099511627776 AS first_id, CAST(b AS BIGINT) * 1099511627776 + count(*) - 1 AS last_id, count(*) FILTER (WHERE nullif(c1, '') IS NULL) AS c1_null, CAST(0 AS BIGINT) AS c1_empty, CAST(sum(label) AS BIGINT) AS clicks, count(*) AS named FROM imp, (VALUES (7), (8)) v(b) GROUP BY b")
EXPECTED = "SELECT CAST(floor((day(ts) - 1) / 10.0) + 1 AS BIGINT) AS batch_id, count(*) + CASE WHEN min(day(ts)) > 20 THEN 1 ELSE 0 END AS expected_row_count FROM events GROUP BY 1 UNION ALL SELECT 99, 5"


def _expected(f: Frames) -> DataFrame:
    day = F.dayofmonth("ts")
    e = binding.table(f.spark, f.dir, "events").groupBy((F.floor((day - 1) / 10.0) + 1).cast("long").alias("batch_id")).agg((F.count(F.lit(1)) + F.when(F.min(day) > 20, 1).otherwise(0)).alias("expected_row_count"))
    return e.unionByName(f.spark.range(1).select(F.lit(99).cast("long").alias("batch_id"), F.lit(5).cast("long").alias("expected_row_count")))


add("s4_load_reconciliation", lambda f: files.reconcile(f.imp, _expected(f)), f"SELECT e.batch_id, e.expected_row_count, coalesce(n, 0) AS loaded_row_count, CASE WHEN e.expected_row_count = coalesce(n, 0) THEN 'MATCH' ELSE 'MISMATCH' END AS load_status FROM ({EXPECTED}) e LEFT JOIN (SELECT batch_id, count(*) AS n FROM imp GROUP BY 1) USING (batch_id)")


def _sink(f: Frames) -> DataFrame:
    return files.write_batch(f.stg, f.path("staging")).select(*[c.strip() for c in STG.split(",")])


def _replaced(f: Frames) -> DataFrame:
    """Batches written, one of them written again: the table is the same."""
    path = f.path("replace")
    tables.replace_batch(f.fact, path)
    tables.replace_batch(f.fact.where("batch_id = 2"), path)
    return f.spark.read.parquet(path).select(*warehouse.FACT)


def _read_json(f: Frames) -> DataFrame:
    path = f.path("metrics")
    files.write_metrics(f.stg, path)
    return f.spark.read.schema(staging.batch_metrics(f.stg).schema).json(path)


def _read_profile(f: Frames) -> DataFrame:
    path = f.path("profile")
    files.write_missing_profile(f.imp, path)
    return f.spark.read.schema("column_name string, missing_count long, missing_rate double").option("header", True).csv(path)


def _read_splits(f: Frames) -> DataFrame:
    path = f.path("splits")
    files.write_splits(f.split, path)
    return f.spark.read.parquet(path).groupBy("dataset_split").agg(F.count(F.lit(1)).alias("row_count"), F.sum("label").alias("clicks"))


def _read_scores(f: Frames) -> DataFrame:
    path = f.path("scores")
    files.write_scores(f.scores, path)
    return f.spark.read.parquet(path).groupBy("model_version").agg(F.count(F.lit(1)).alias("row_count"), F.count_if("is_top_decile").alias("top_rows"))


def _read_importance(f: Frames) -> DataFrame:
    path = f.path("importance")
    files.write_importance(f.limp, path, 10)
    return f.spark.read.schema(f.limp.schema).option("header", True).csv(f"{path}/top").select("model_name", "feature_name", "importance_rank")


METRICS_SQL = "SELECT count(*) AS row_count, CAST(sum(click_count) AS BIGINT) AS clicks, round(avg(label), 6) AS ctr, round(avg(missing_numeric_count), 6) AS avg_missing_numeric_count, round(avg(missing_categorical_count), 6) AS avg_missing_categorical_count FROM stg"
PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS missing_count, {O.ratio(f'count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = {chr(39)}{chr(39)})', 'count(*)')} AS missing_rate FROM imp" for c in ["label", *NUMERIC, *CATEGORICAL])
COLS = [c for c in source_schema().fieldNames()]
MANIFEST_COLUMNS = ["event_day_number", "event_batch", "missing_numeric_count", "missing_categorical_count", "has_missing_numeric", "has_missing_categorical", "high_missingness_flag", *NUMERIC, *(f"{c}_log_scale" for c in NUMERIC), *STORED, *(f"{c}_bucket_code" for c in NUMERIC), *(f"{c}_bucket_ctr_lift" for c in NUMERIC), *(f"{c}_ctr_lift" for c in STORED), *(f"{c}_feature_impressions" for c in STORED), "overall_ctr"]
add("s5_parquet_sink", _sink, f"SELECT {STG} FROM stg")
add("s6_metrics_sink", _read_json, METRICS_SQL)
add("s7_missing_profile_sink", _read_profile, PROFILE_SQL)
add("s8_split_export", _read_splits, "SELECT dataset_split, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS clicks FROM split GROUP BY 1")
add("s9_manifest", lambda f: features.manifest(f.split), f"SELECT dataset_split, count(*) AS row_count, string_agg(DISTINCT CAST(event_day_number AS VARCHAR), ',' ORDER BY CAST(event_day_number AS VARCHAR)) AS split_days, '{','.join(MANIFEST_COLUMNS)}' AS feature_columns FROM split GROUP BY 1")
add("s10_prediction_sink", _read_scores, "SELECT model_version, count(*) AS row_count, count(*) FILTER (WHERE is_top_decile) AS top_rows FROM scores GROUP BY 1")
add("s11_importance_sink", _read_importance, "SELECT model_name, feature_name, CAST(importance_rank AS INT) AS importance_rank FROM limp WHERE importance_rank <= 10")
add("s12_replace_batch", _replaced, "SELECT * FROM fact")
add("s13_insert_new", lambda f: tables.insert_new(f.stg.select("event_batch", "event_day_number").distinct(), f.stg.where("batch_id = 1").select("event_batch", "event_day_number"), ["event_batch", "event_day_number"]), "SELECT DISTINCT event_batch, event_day_number FROM stg EXCEPT SELECT event_batch, event_day_number FROM stg WHERE batch_id = 1")


def _upserted(f: Frames) -> DataFrame:
    """Benchmarks of even ids stand, those of odd ids come in; the newest by date stays, and a speed is kept where the newest has none."""
    s = f.of(binding.benchmark_snapshots).select("batch_id", "benchmark_name", (F.unix_date("recorded_at").cast("long") * 1_000_000 + F.col("benchmark_id")).alias("version"), "benchmark_id", "rows_per_second")
    return tables.upsert(s.where("benchmark_id % 2 = 0"), s.where("benchmark_id % 2 = 1"), ["batch_id", "benchmark_name"], "version", ["rows_per_second"])


add("s14_upsert", _upserted, "SELECT batch_id, benchmark_name, max(v) AS version, max_by(benchmark_id, v) AS benchmark_id, max_by(rows_per_second, v) FILTER (WHERE rows_per_second IS NOT NULL) AS rows_per_second FROM (SELECT *, CAST(recorded_at - DATE '1970-01-01' AS BIGINT) * 1000000 + benchmark_id AS v FROM snaps) GROUP BY 1, 2")


def _registered(f: Frames) -> DataFrame:
    r = f.reg.select(F.col("batch_name").alias("checksum"), F.col("source_file").alias("batch_name"), "batch_status", F.lit("2024-01-01").cast("date").alias("last_seen_at"))
    incoming = f.reg.where("batch_id % 3 = 0").select(F.col("batch_name").alias("checksum"), F.col("source_file").alias("batch_name"))
    incoming = incoming.unionByName(f.reg.where("batch_id % 4 = 0").select(F.concat("batch_name", F.lit("_new")).alias("checksum"), F.col("source_file").alias("batch_name")))
    return tables.register_by_checksum(r, incoming, F.lit("2024-03-01").cast("date"))


add("s15_register_by_checksum", _registered, "SELECT batch_name AS checksum, source_file AS batch_name, batch_status, CASE WHEN batch_id % 3 = 0 THEN DATE '2024-03-01' ELSE DATE '2024-01-01' END AS last_seen_at FROM reg UNION ALL SELECT batch_name || '_new', source_file, 'REGISTERED', DATE '2024-03-01' FROM reg WHERE batch_id % 4 = 0")
add("s16_retention", lambda f: tables.keep_recent(f.of(binding.benchmark_snapshots), "recorded_at", F.lit("1998-06-01").cast("timestamp")).select("benchmark_id", "recorded_at"), "SELECT benchmark_id, recorded_at FROM snaps WHERE recorded_at >= DATE '1998-06-01' - INTERVAL 90 DAYS")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)


def _stored_upsert(f: Frames) -> DataFrame:
    """The same into a stored table, in three changes, of which the second touches one key and so one bucket."""
    s = f.of(binding.benchmark_snapshots).select("batch_id", "benchmark_name", (F.unix_date("recorded_at").cast("long") * 1_000_000 + F.col("benchmark_id")).alias("version"), "benchmark_id", "rows_per_second")
    keys = ["batch_id", "benchmark_name"]
    table = keyed.KeyedTable(f.spark, f.path("upserted"), ddl(s), keys, 64)
    put = lambda old, new: tables.upsert(old, new, keys, "version", ["rows_per_second"])
    one = (F.col("batch_id") == 1) & (F.col("benchmark_name") == "file_storage")
    written = [table.change(part, put) for part in (s.where("benchmark_id % 2 = 0"), s.where("benchmark_id % 2 = 1").where(one), s.where("benchmark_id % 2 = 1").where(~one))]
    table.drop_old()
    return table.read().withColumn("buckets_of_one_key", F.lit(written[1]))


add("s14_stored_upsert", _stored_upsert, "SELECT batch_id, benchmark_name, max(v) AS version, max_by(benchmark_id, v) AS benchmark_id, max_by(rows_per_second, v) FILTER (WHERE rows_per_second IS NOT NULL) AS rows_per_second, 1 AS buckets_of_one_key FROM (SELECT *, CAST(recorded_at - DATE '1970-01-01' AS BIGINT) * 1000000 + benchmark_id AS v FROM snaps) GROUP BY 1, 2")


def _stored_retention(f: Frames) -> DataFrame:
    """Old snapshots are deleted from a stored table, with their files."""
    s = f.of(binding.benchmark_snapshots).select("benchmark_id", "recorded_at")
    table = keyed.KeyedTable(f.spark, f.path("kept"), ddl(s), ["benchmark_id"], 16)
    table.change(s, lambda old, new: new)
    table.change(None, lambda old, _: tables.keep_recent(old, "recorded_at", F.lit("1998-06-01").cast("timestamp")))
    table.drop_old()
    return table.read()


add("s16_stored_retention", _stored_retention, "SELECT benchmark_id, recorded_at FROM snaps WHERE recorded_at >= DATE '1998-06-01' - INTERVAL 90 DAYS")
add("s17_latest_batch", lambda f: tables.latest_batch(f.imp), "SELECT batch_id, source_file, count(*) AS row_count, max(ingested_at) AS latest_ingested_at FROM imp GROUP BY 1, 2 ORDER BY 4 DESC, 1 DESC, 2 LIMIT 1")
add("s18_batch_by_name", lambda f: tables.batch_by_name(f.reg, "batch_5"), "SELECT batch_id, batch_name, source_type, sample_scale, expected_row_count FROM reg WHERE batch_name = 'batch_5' ORDER BY batch_id DESC LIMIT 1")
add("s19_scale_and_name", lambda f: f.reg.select("batch_id", tables.sample_scale(F.concat("sample_scale", F.lit(" Live-Batch "), "source_file")).alias("scale"), tables.batch_name(F.concat("sample_scale", F.lit(" Live-Batch "), "source_file"), F.concat("batch_name", F.lit("0123456789abcdef"))).alias("name")), "SELECT batch_id, sample_scale AS scale, replace(replace(lower(concat(sample_scale, ' Live-Batch ', replace(source_file, '.csv', ''))), ' ', '_'), '-', '_') || '_' || substr(batch_name || '0123456789abcdef', 1, 12) AS name FROM reg")
add("s20_content_digest", lambda f: tables.content_digest(f.imp, ["source_file"], ["label", *NUMERIC, *CATEGORICAL]))
add("s21_run_states", lambda f: tables.run_states(f.of(binding.run_log)), "SELECT o_orderkey AS pipeline_run_id, CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'O' THEN 'SUCCESS' ELSE 'FAILED' END AS run_status, CASE WHEN o_orderstatus = 'P' THEN 'started' ELSE concat('ended ', o_orderpriority) END AS run_message, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 THEN o_orderkey % 500 ELSE o_orderkey % 1000 END AS row_count, CAST(o_orderdate AS DATE) AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) END AS completed_at FROM orders")
add("s22_batch_states", lambda f: tables.batch_states(f.of(binding.batch_log)), "SELECT o_custkey % 30 + 1 AS batch_id, max_by(CASE o_orderstatus WHEN 'O' THEN 'COMPLETED' WHEN 'F' THEN 'FAILED' ELSE 'RUNNING' END, o_orderkey) AS batch_status, max_by('stage_' || CAST(o_orderkey % 5 AS VARCHAR), o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS last_successful_stage, max_by(o_orderkey % 1000, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS actual_row_count, CAST(min(o_orderdate) AS DATE) AS started_at, CAST(max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS DATE) AS completed_at FROM orders GROUP BY 1")

# --- 2.2 projections and scalars ---
E = "event_id"


def scalar(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    add(name, lambda f: f.imp.select(E, *(c.alias(n) for n, c in columns().items())), f"SELECT event_id, {sql} FROM imp")


scalar("p1_label", lambda: {"label": X.clean_label(F.nullif(F.col("label"), F.lit(0)))}, "label")
scalar("p2_numeric_fill", lambda: {c: X.fill_numeric(c) for c in NUMERIC}, J(f"coalesce({c}, 0) AS {c}" for c in NUMERIC))
scalar("p3_categorical_fill", lambda: {c: X.fill_categorical(c) for c in CATEGORICAL}, J(f"coalesce(nullif({c}, ''), 'unknown') AS {c}" for c in CATEGORICAL))
scalar("p4_missing_numeric", lambda: {"missing_numeric_count": X.missing_numeric(NUMERIC)}, f"{O.MISSING_N} AS missing_numeric_count")
scalar("p5_missing_categorical", lambda: {"missing_categorical_count": X.missing_categorical(CATEGORICAL)}, f"{O.MISSING_C} AS missing_categorical_count")
scalar("p6_event_batch", lambda: {"event_batch": X.event_batch("source_file")}, "CASE WHEN source_file LIKE '%100k%' THEN '100k' WHEN source_file LIKE '%1m%' THEN '1m' WHEN source_file LIKE '%5m%' THEN '5m' ELSE 'full' END AS event_batch")
add("p8_staging", lambda f: f.stg, f"SELECT {STG} FROM stg")
add("p9_hash_event_day", lambda f: staging.hashed(f.imp).select("raw_event_id", "event_day_number"))
scalar("p10_bucket_code", lambda: {f"{c}_bucket_code": X.bucket_code(X.fill_numeric(c)) for c in NUMERIC}, J(f"{O.bucket(f'coalesce({c}, 0)')} AS {c}_bucket_code" for c in NUMERIC))
scalar("p11_log_scale", lambda: {f"{c}_log_scale": F.round(X.log_scale(X.fill_numeric(c)), 9) for c in NUMERIC}, J(f"round(ln(1 + greatest(coalesce({c}, 0), 0)), 9) AS {c}_log_scale" for c in NUMERIC))
add("p19_durations", lambda f: f.reg.select("batch_id", X.duration_s("created_at", "completed_at", F.lit(O.AS_OF).cast("timestamp_ntz")).alias("duration_seconds")), f"SELECT batch_id, round((epoch_us(coalesce(completed_at, TIMESTAMP '{O.AS_OF}')) - epoch_us(created_at)) / 1e6, 3) AS duration_seconds FROM reg")
PREDICATES = {"listed": ("i3 IN (1, 2, 3)", lambda: F.col("i3").isin(1, 2, 3)), "inside": ("i4 BETWEEN 1 AND 10", lambda: F.col("i4").between(1, 10)), "outside": ("i5 NOT BETWEEN 1 AND 10", lambda: ~F.col("i5").between(1, 10)), "differs": ("label <> 1", lambda: F.col("label") != 1), "absent": ("i2 IS NULL", lambda: F.col("i2").isNull())}
scalar("p21_threshold_predicates", lambda: {n: F.coalesce(make().cast("int"), F.lit(-1)) for n, (_, make) in PREDICATES.items()}, J(f"coalesce(CAST({sql} AS INT), -1) AS {n}" for n, (sql, _) in PREDICATES.items()))
add("p22_batch_filter", lambda f: f.imp.where("batch_id = 2").select("event_id", "batch_id", "source_file"), "SELECT event_id, batch_id, source_file FROM imp WHERE batch_id = 2")
add("p23_json_payload", lambda f: f.truns.select("training_run_id", F.to_json(F.struct("rows_trained", "train_batch_name")).alias("payload"), F.from_json(F.to_json(F.array("train_batch_name", "run_status")), "array<string>")[1].alias("second")), """SELECT training_run_id, concat('{"rows_trained":', rows_trained, ',"train_batch_name":"', train_batch_name, '"}') AS payload, run_status AS second FROM truns""")

# --- 2.3 joins that no composite below stands for ---
add("j11_newest_run_filter", lambda f: f.of(binding.validation_results).join(F.broadcast(f.of(binding.validation_runs).agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi").select("validation_id", "run_id", "check_status"), "SELECT validation_id, run_id, check_status FROM vres WHERE run_id = (SELECT max(run_id) FROM vruns)")
add("j12_unpivot_categorical", lambda f: warehouse.unpivot(f.stg, CATEGORICAL, ["raw_event_id"]), "SELECT raw_event_id, feature_name, feature_value FROM long_c")

# --- 2.4 aggregations and 2.8 marts ---
add("a1_batch_overall", lambda f: f.b_overall, "SELECT * FROM b_overall")
add("a2_batch_event_day", lambda f: f.b_day, "SELECT * FROM b_day")
add("a3_batch_numeric_bucket", lambda f: f.b_bucket, "SELECT * FROM b_bucket")
add("a4_batch_feature", lambda f: f.b_feature, "SELECT * FROM b_feature")
add("a5_batch_missing", lambda f: f.b_missing, "SELECT * FROM b_missing")
add("a6_interaction_c22_c19", lambda f: marts.interaction_c22_c19(f.stg), "SELECT * FROM b_inter1")
add("a7_interaction_c22_c6", lambda f: marts.interaction_c22_c6(f.stg), "SELECT * FROM b_inter2")
add("a8_interaction_i1_c22", lambda f: marts.interaction_i1_c22(f.stg), "SELECT * FROM b_inter3")
add("a11_event_day_summary", lambda f: warehouse.event_day_summary(f.fact, f.days), f"SELECT f.event_batch, d.event_day_number, d.day_label, {O.SUMS}, {O.AVGS} FROM fact f JOIN dday d USING (event_day_key) GROUP BY ALL")
add("a12_data_quality_summary", lambda f: warehouse.data_quality_summary(f.fact), f"SELECT event_batch, source_file, count(*) AS row_count, {O.AVGS}, max(missing_numeric_count) AS max_missing_numeric_count, max(missing_categorical_count) AS max_missing_categorical_count FROM fact GROUP BY ALL")
add("a13_batch_metrics", lambda f: staging.batch_metrics(f.stg), METRICS_SQL)
add("a14_missing_profile", lambda f: staging.missing_profile(f.imp), PROFILE_SQL)
add("a15_unknown_profile", lambda f: staging.unknown_profile(f.stg), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 'unknown') AS unknown_rows, {O.ratio(f'count(*) FILTER (WHERE {c} = {chr(39)}unknown{chr(39)})', 'count(*)')} AS unknown_rate FROM stg" for c in CATEGORICAL))
add("a17_duplicate_groups", lambda f: quality._duplicates(f.of(binding.pipeline_steps), "pipeline_run_id"), "SELECT count(*) AS duplicate_groups FROM (SELECT pipeline_run_id FROM steps GROUP BY 1 HAVING count(*) > 1)")
add("a18_file_names", lambda f: f.imp.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("c22")), ", ").alias("names")), "SELECT batch_id, string_agg(DISTINCT c22, ', ' ORDER BY c22) AS names FROM imp GROUP BY 1")
add("a20_metric_pivot", lambda f: monitor.metric_pivot(f.models, f.truns, f.tmetrics), "SELECT * FROM mpivot")
add("a22_source_report", lambda f: f.imp.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")), "SELECT source_file, count(*) AS row_count, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM imp GROUP BY 1")
add("a23_store_by_label", lambda f: f.store.groupBy("batch_id", "label").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.avg("c22_ctr_lift"), 6).alias("avg_c22_lift"), F.round(F.avg("i1_bucket_ctr_lift"), 6).alias("avg_i1_lift")), "SELECT batch_id, label, count(*) AS row_count, round(avg(c22_ctr_lift), 6) AS avg_c22_lift, round(avg(i1_bucket_ctr_lift), 6) AS avg_i1_lift FROM store GROUP BY 1, 2")
add("a24_status_counts", lambda f: quality.status_counts(f.of(binding.validation_results)), "SELECT layer_name, check_status, count(*) AS checks FROM vres GROUP BY 1, 2")
add("a26_storage_rollup", lambda f: ops.storage_rollup(f.bench), "SELECT * FROM storage")
add("m1_dim_event_day", lambda f: f.days, "SELECT * FROM dday")
add("m2_dim_numeric_bucket", lambda f: warehouse.dim_numeric_bucket(f.spark).join(f.b_bucket.groupBy("feature_name", "bucket_code").agg(F.sum("impressions").alias("impressions")), ["feature_name", "bucket_code"], "left"), "SELECT CAST(7 * (CAST(substr(n.f, 2) AS INT) - 1) + b.o AS BIGINT) AS numeric_bucket_key, n.f AS feature_name, b.c AS bucket_code, b.l AS bucket_label, b.o AS bucket_order, CAST(b.lo AS BIGINT) AS lower_bound, CAST(b.hi AS BIGINT) AS upper_bound, x.impressions FROM (VALUES " + J(f"('{c}')" for c in NUMERIC) + ") n(f), (VALUES ('negative', 'negative values', 1, NULL, -1), ('zero', '0', 2, 0, 0), ('1_10', '1 to 10', 3, 1, 10), ('11_100', '11 to 100', 4, 11, 100), ('101_1000', '101 to 1000', 5, 101, 1000), ('1001_10000', '1001 to 10000', 6, 1001, 10000), ('10001_plus', '10001 and above', 7, 10001, NULL)) b(c, l, o, lo, hi) LEFT JOIN (SELECT feature_name, bucket_code, CAST(sum(impressions) AS BIGINT) AS impressions FROM b_bucket GROUP BY 1, 2) x ON x.feature_name = n.f AND x.bucket_code = b.c")
add("m3_dim_categorical_value", lambda f: warehouse.dim_categorical_value(f.stg).drop("categorical_value_key"), "SELECT DISTINCT feature_name, feature_value, feature_value = 'unknown' AS is_unknown FROM long_c")
add("m4_fact_ad_events", lambda f: f.fact, "SELECT * FROM fact")
add("m5_bridge_numeric_bucket", lambda f: warehouse.bridge_numeric_bucket(f.stg, warehouse.dim_numeric_bucket(f.spark)), f"SELECT raw_event_id, batch_id, CAST(7 * (CAST(substr(feature_name, 2) AS INT) - 1) + {O._order('bucket_code')} AS BIGINT) AS numeric_bucket_key, feature_name, feature_value FROM long_n")


def _bridged(f: Frames) -> DataFrame:
    """What the bridge's keys stand for in the dimension."""
    values = saved(warehouse.dim_categorical_value(f.stg), "values")
    bridge = warehouse.bridge_categorical_value(f.stg, values).withColumnRenamed("feature_value", "bridge_value")
    return bridge.select("raw_event_id", "batch_id", "categorical_value_key", "bridge_value").join(values, "categorical_value_key").drop("categorical_value_key")


add("m6_bridge_categorical_value", _bridged, "SELECT raw_event_id, batch_id, feature_value AS bridge_value, feature_name, feature_value, feature_value = 'unknown' AS is_unknown FROM long_c")
add("m7_overall", lambda f: f.m_overall, "SELECT * FROM m_overall")
add("m8_event_day_trend", lambda f: f.m_day, "SELECT * FROM m_day")
add("m9_numeric_bucket_ctr", lambda f: f.m_bucket, "SELECT * FROM m_bucket")
add("m10_feature_ctr", lambda f: f.m_feature, "SELECT * FROM m_feature")
add("m11_missing_value_impact", lambda f: f.m_missing, "SELECT * FROM m_missing")
add("m12_feature_interaction_ctr", lambda f: f.m_inter, "SELECT * FROM m_inter")
add("m13_feature_ranked", lambda f: f.r_feature, "SELECT * FROM r_feature")
add("m14_event_day_rolling", lambda f: f.r_rolling, "SELECT * FROM r_rolling")
add("m15_high_value_segments", lambda f: f.r_high, "SELECT * FROM r_high")
add("m16_low_performing_segments", lambda f: f.r_low, "SELECT * FROM r_low")
add("m17_feature_lift_ranked", lambda f: f.r_lift, "SELECT * FROM r_lift")
add("m18_feature_interaction_ranked", lambda f: f.r_inter, "SELECT * FROM r_inter")

# --- 2.5 windows and 2.6 top-k ---
add("w1_event_day_window", lambda f: staging.with_event_day_window(f.imp).select("event_id", "event_day_number"), "SELECT raw_event_id AS event_id, event_day_number FROM stg")
add("w1_event_day_distributed", lambda f: staging.with_event_day(f.imp).select("event_id", "event_day_number"), "SELECT raw_event_id AS event_id, event_day_number FROM stg")
add("w18_score_deciles", lambda f: f.scores.select("raw_event_id", "batch_id", "model_id", "score_decile", "is_top_decile"), "SELECT raw_event_id, batch_id, model_id, score_decile, is_top_decile FROM scores")
# Of several active models of a name one stays; the order of these keys is part of the behaviour.
MARKED = "SELECT * EXCLUDE (is_active_canonical), model_id < 8 AS is_active_canonical FROM models"
STAYS = "coalesce(c.validation_roc_auc, 0) DESC, coalesce(c.validation_pr_auc, 0) DESC, coalesce(c.validation_lift_at_10pct, 0) DESC, CASE WHEN m.model_version = 'v4' THEN 0 ELSE 1 END, m.canonical_promoted_at DESC NULLS LAST, t.training_run_id DESC NULLS LAST, m.model_id DESC"
ONE_ACTIVE = f"SELECT model_id, model_name FROM (SELECT m.model_id, m.model_name, row_number() OVER (PARTITION BY m.model_name ORDER BY {STAYS}) AS rk FROM ({MARKED}) m LEFT JOIN truns t ON t.model_id = m.model_id AND t.run_status = 'SUCCESS' LEFT JOIN (SELECT DISTINCT model_name, model_version, training_run_id, validation_roc_auc, validation_pr_auc, validation_lift_at_10pct FROM mcomp) c ON c.model_name = m.model_name AND c.model_version = m.model_version AND c.training_run_id = t.training_run_id WHERE m.is_active_canonical) WHERE rk = 1"


def _several_active(f: Frames) -> DataFrame:
    return f.models.withColumn("is_active_canonical", F.col("model_id") < 8)


add("w20_one_active_model", lambda f: promote.normalise(_several_active(f), f.truns, f.mcomp, "v4").where("is_active_canonical").select("model_id", "model_name"), ONE_ACTIVE)
add("t1_staging_in_order", lambda f: f.stg.select("raw_event_id", "batch_id").repartitionByRange("raw_event_id").sortWithinPartitions("raw_event_id"), "SELECT raw_event_id, batch_id FROM stg")
add("t2_top_buckets", lambda f: marts.top(f.m_bucket, "ctr_rank_in_feature", MEDIUM_BUCKET), f"SELECT * FROM m_bucket WHERE impressions >= {MEDIUM_BUCKET} AND ctr_rank_in_feature <= 5")
add("t2_top_features", lambda f: marts.top(f.m_feature, "ctr_rank_in_feature", MEDIUM), f"SELECT * FROM m_feature WHERE impressions >= {MEDIUM} AND ctr_rank_in_feature <= 5")
add("t2_top_interactions", lambda f: marts.top(f.m_inter, "ctr_rank_in_interaction", LEAST_PAIR), f"SELECT * FROM m_inter WHERE impressions >= {LEAST_PAIR} AND ctr_rank_in_interaction <= 5")
add("t3_listing", lambda f: f.m_feature.orderBy(F.desc("impressions"), F.desc("ctr"), "feature_name", "feature_value").limit(25), "SELECT * FROM m_feature ORDER BY impressions DESC, ctr DESC, feature_name, feature_value LIMIT 25")
add("t4_top_features_by_importance", lambda f: importance.top_features(f.limp, 5).select("model_name", "feature_name", "importance_rank"), "SELECT model_name, feature_name, CAST(importance_rank AS INT) AS importance_rank FROM limp WHERE importance_rank <= 5")

# --- 2.9 quality ---
LIMITS = "(VALUES ('c22', 0.80e0, 0.90e0), ('c19', 0.50e0, 0.65e0), ('c20', 0.50e0, 0.65e0), ('c25', 0.50e0, 0.65e0), ('c26', 0.50e0, 0.65e0)) l(column_name, w, e)"


def _result(layer: str, table: str, name: str, kind: str, ok: str, actual: str, expected: str, message: str, source: str) -> str:
    return f"SELECT '{layer}' AS layer_name, '{table}' AS table_name, '{name}' AS check_name, '{kind}' AS check_type, 'error' AS severity, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS check_status, CAST({actual} AS VARCHAR) AS actual_value, CAST({expected} AS VARCHAR) AS expected_value, CAST(NULL AS VARCHAR) AS threshold_value, '{message}' AS check_message FROM {source} HAVING count(*) >= 0"


def six(c: str) -> str:
    return f"printf('%.6f', {c})"


Q1 = " UNION ALL ".join(
    _result("raw", quality.RAW, n, k, ok, a, e, m, "imp")
    for n, k, ok, a, e, m in (
        ("raw row count greater than zero", "row_count", "count(*) > 0", "count(*)", "'> 0'", "Raw layer should contain rows after ingestion."),
        ("label must be 0 or 1", "validity", "count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1)) = 0", "count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1))", "'0 invalid rows'", "All raw labels must be binary."),
        ("source_file not null", "completeness", "count(*) FILTER (WHERE source_file IS NULL) = 0", "count(*) FILTER (WHERE source_file IS NULL)", "'0 null rows'", "source_file must be present on all raw rows."),
        ("ingested_at not null", "freshness", "count(*) FILTER (WHERE ingested_at IS NULL) = 0", "count(*) FILTER (WHERE ingested_at IS NULL)", "'0 null rows'", "ingested_at must be present on all raw rows."),
    )
)
DUP = "(SELECT count(*) FROM (SELECT raw_event_id FROM {t} GROUP BY 1 HAVING count(*) > 1))"
Q2 = " UNION ALL ".join(
    _result("staging", quality.STAGING, n, k, ok, a, e, m, "stg")
    for n, k, ok, a, e, m in (
        ("row count parity with raw", "consistency", "count(*) = (SELECT count(*) FROM imp)", "count(*)", "(SELECT count(*) FROM imp)", "Staging row count should match raw row count."),
        ("raw_event_id uniqueness", "uniqueness", f"{DUP.format(t='stg')} = 0", DUP.format(t="stg"), "'0 duplicate groups'", "raw_event_id must uniquely identify staging rows."),
        ("click_flag binary validity", "validity", "count(*) FILTER (WHERE click_flag NOT IN (0, 1)) = 0", "count(*) FILTER (WHERE click_flag NOT IN (0, 1))", "'0 invalid rows'", "click_flag must be 0 or 1."),
        ("click_count binary validity", "validity", "count(*) FILTER (WHERE click_count NOT IN (0, 1)) = 0", "count(*) FILTER (WHERE click_count NOT IN (0, 1))", "'0 invalid rows'", "click_count must be 0 or 1."),
        ("impression_count must equal 1", "validity", "count(*) FILTER (WHERE impression_count <> 1) = 0", "count(*) FILTER (WHERE impression_count <> 1)", "'0 invalid rows'", "Every staging row should represent exactly one impression."),
    )
)
RATES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CAST({c} = 'unknown' AS INT)), 6) AS rate FROM stg" for c in ("c22", "c19", "c20", "c25", "c26"))
Q3 = f"SELECT 'staging' AS layer_name, '{quality.STAGING}' AS table_name, column_name || ' unknown rate threshold' AS check_name, 'completeness' AS check_type, 'warning' AS severity, CASE WHEN rate <= w THEN 'PASS' WHEN rate <= e THEN 'WARN' ELSE 'FAIL' END AS check_status, {six('rate')} AS actual_value, '<= ' || {six('w')} AS expected_value, {six('e')} AS threshold_value, 'Configured unknown-rate threshold for sparse categorical columns.' AS check_message FROM ({RATES}) JOIN {LIMITS} USING (column_name)"
WCTR = O.ratio("sum(click_count)", "sum(impression_count)")
Q4 = " UNION ALL ".join(
    _result("warehouse", quality.FACT, n, k, ok, a, e, m, "fact")
    for n, k, ok, a, e, m in (
        ("row count parity with staging", "consistency", "count(*) = (SELECT count(*) FROM stg)", "count(*)", "(SELECT count(*) FROM stg)", "Warehouse fact row count should match staging row count."),
        ("raw_event_id uniqueness", "uniqueness", f"{DUP.format(t='fact')} = 0", DUP.format(t="fact"), "'0 duplicate groups'", "raw_event_id must uniquely identify fact rows."),
        ("event_day_key not null", "completeness", "count(*) FILTER (WHERE event_day_key IS NULL) = 0", "count(*) FILTER (WHERE event_day_key IS NULL)", "'0 null rows'", "Every fact row should map to an event-day dimension key."),
        ("warehouse ctr between 0 and 1", "range", f"{WCTR} BETWEEN 0 AND 1", six(WCTR), "'0 to 1'", "Warehouse CTR must stay within valid probability bounds."),
    )
)
MARTS = {"overall": "m_overall", "event_day": "m_day", "numeric": "m_bucket", "feature": "m_feature", "missing": "m_missing", "interaction": "m_inter"}
RANKED = {"feature_ranked": "r_feature", "rolling": "r_rolling", "high_value": "r_high", "low_value": "r_low", "lift_ranked": "r_lift", "interaction_ranked": "r_inter"}


def _counts(tables_: dict[str, str]) -> tuple[str, str]:
    n = {k: f"(SELECT count(*) FROM {t})" for k, t in tables_.items()}
    return " AND ".join(f"{x} > 0" for x in n.values()), " || ".join(f"'{', ' * (i > 0)}{k}=' || {x}" for i, (k, x) in enumerate(n.items()))


OK5, SAID5 = _counts(MARTS)
OK6, SAID6 = _counts(RANKED)
Q5 = _result("marts", "marts layer", "mart row counts greater than zero", "row_count", OK5, SAID5, "'all mart row counts > 0'", "All primary mart objects should be populated.", "m_overall") + " UNION ALL " + _result("marts", "marts layer", "mart ctr values between 0 and 1", "range", "(SELECT max(ctr) FROM m_overall) BETWEEN 0 AND 1 AND (SELECT max(ctr) FROM m_day) BETWEEN 0 AND 1", f"'overall=' || (SELECT {six('max(ctr)')} FROM m_overall) || ', max_event_day=' || (SELECT {six('max(ctr)')} FROM m_day)", "'0 to 1'", "Mart CTR outputs must stay within valid probability bounds.", "m_overall")
ROLL = "rolling_3_day_weighted_ctr"
Q6 = _result("advanced_sql", "advanced sql layer", "advanced outputs populated", "row_count", OK6, SAID6, "'all advanced outputs > 0'", "All advanced SQL assets should be populated.", "m_overall") + " UNION ALL " + _result("advanced_sql", "marts.event_day_ctr_rolling", "rolling ctr between 0 and 1", "range", f"min({ROLL}) BETWEEN 0 AND 1 AND max({ROLL}) BETWEEN 0 AND 1", f"'min=' || {six(f'min({ROLL})')} || ', max=' || {six(f'max({ROLL})')}", "'0 to 1'", "Rolling CTR outputs must stay within valid probability bounds.", "r_rolling")
Q7 = " UNION ALL ".join(
    _result("feature_store", quality.STORE, n, k, ok, a, e, m, "store")
    for n, k, ok, a, e, m in (
        ("feature store row count parity", "consistency", "count(*) = (SELECT count(*) FROM fact)", "count(*)", "(SELECT count(*) FROM fact)", "Feature store rows should match warehouse fact rows."),
        ("feature store labels valid", "validity", "count(*) FILTER (WHERE label NOT IN (0, 1)) = 0", "count(*) FILTER (WHERE label NOT IN (0, 1))", "'0 invalid rows'", "Feature store labels must remain binary."),
        ("feature store raw_event_id uniqueness", "uniqueness", f"{DUP.format(t='store')} = 0", DUP.format(t="store"), "'0 duplicate groups'", "Feature store should keep one row per raw event."),
        ("feature store event_day_number validity", "validity", "count(*) FILTER (WHERE event_day_number NOT BETWEEN 1 AND 7) = 0", "count(*) FILTER (WHERE event_day_number NOT BETWEEN 1 AND 7)", "'0 invalid rows'", "Feature store event_day_number should stay within the 1 to 7 derived training window."),
    )
)


def _marts(f: Frames) -> dict[str, DataFrame]:
    return {"overall": f.m_overall, "event_day": f.m_day, "numeric": f.m_bucket, "feature": f.m_feature, "missing": f.m_missing, "interaction": f.m_inter}


def _ranked(f: Frames) -> dict[str, DataFrame]:
    return {"feature_ranked": f.r_feature, "rolling": f.r_rolling, "high_value": f.r_high, "low_value": f.r_low, "lift_ranked": f.r_lift, "interaction_ranked": f.r_inter}


CHECKS: dict[str, tuple[Callable[[Frames], DataFrame], str]] = {
    "q1_raw_checks": (lambda f: quality.raw_checks(f.imp), Q1),
    "q2_staging_checks": (lambda f: quality.staging_checks(f.imp, f.stg), Q2),
    "q3_sparsity_checks": (lambda f: quality.sparsity_checks(f.stg, quality.thresholds(f.spark)), Q3),
    "q4_warehouse_checks": (lambda f: quality.warehouse_checks(f.stg, f.fact), Q4),
    "q5_marts_checks": (lambda f: quality.marts_checks(_marts(f)), Q5),
    "q6_advanced_checks": (lambda f: quality.advanced_checks(_ranked(f)), Q6),
    "q7_feature_store_checks": (lambda f: quality.feature_store_checks(f.fact, f.store), Q7),
}
for _name, (_make, _sql) in CHECKS.items():
    add(_name, _make, _sql)


def _full_run(f: Frames) -> DataFrame:
    """Builds every layer once and checks it by what was seen while it was written."""
    seen = quality.Observer()
    names = {attribute: name for name, attribute in [*MARTS.items(), *RANKED.items()]}
    f.save = lambda df, name: seen.write(df, names[name], quality.mart_metrics(names[name])) if name in names else saved(df, name)
    dated = lambda raw: seen.watch(staging.with_event_day(raw), "raw", quality.raw_metrics())
    f.stg = seen.write(staging.build(f.imp, dated), "staging", [*quality.staging_metrics(), *quality.sparsity_metrics()])
    f.fact = seen.write(f.fact, "fact", quality.fact_metrics())
    for attribute, name in names.items():
        table = getattr(f, attribute)
        if not seen.has(name):  # it isn't one of those that are written anyway
            setattr(f, attribute, f.save(table, attribute))
    f.stored_lifts = f.m_feature  # written anyway
    f.store = seen.write(f.store, "store", quality.store_metrics())
    parts = quality.observed_checks(seen, {"staging": f.stg, "fact": f.fact, "store": f.store}, list(MARTS), list(RANKED), quality.thresholds(f.spark))
    return quality.all_checks(parts, 42, 3, f.stg)


add("q8_full_run", _full_run, "SELECT CAST(42 AS BIGINT) AS run_id, CAST(3 AS BIGINT) AS batch_id, *, (SELECT string_agg(DISTINCT source_file, ', ' ORDER BY source_file) FROM imp) AS source_file FROM (" + " UNION ALL ".join(s for _, s in CHECKS.values()) + ")")
add("q9_latest_validation", lambda f: quality.latest_validation(f.of(binding.validation_results)), O.newest("vres", "layer_name, check_name", "checked_at DESC, validation_id DESC"))
add("q10_validation_dashboard", lambda f: quality.dashboard(f.of(binding.validation_runs), f.of(binding.validation_results)), "SELECT r.run_id, r.pipeline_name, r.run_status, r.started_at, r.completed_at, count(*) AS total_checks, count(*) FILTER (WHERE check_status = 'PASS') AS pass_checks, count(*) FILTER (WHERE check_status = 'WARN') AS warn_checks, count(*) FILTER (WHERE check_status = 'FAIL') AS fail_checks, count(*) FILTER (WHERE severity = 'error') AS error_severity_checks, count(*) FILTER (WHERE severity = 'warning') AS warning_severity_checks FROM vruns r LEFT JOIN vres USING (run_id) WHERE r.run_id = (SELECT max(run_id) FROM vruns) GROUP BY ALL")
add("q12_layer_report", lambda f: quality.layer_report(f.stg, ["batch_id", "event_day_number"], {"negative_i2": F.col("i2") < 0, "unknown_c22": F.col("c22") == "unknown", "clicked": F.col("click_flag") == 1}), "SELECT batch_id, event_day_number, count(*) AS row_count, count(*) FILTER (WHERE i2 < 0) AS negative_i2, count(*) FILTER (WHERE c22 = 'unknown') AS unknown_c22, count(*) FILTER (WHERE click_flag = 1) AS clicked FROM stg GROUP BY 1, 2")
add("q13_constraints", lambda f: quality.violations(f.scores), "SELECT count(*) FILTER (WHERE predicted_ctr NOT BETWEEN 0 AND 1) AS predicted_out_of_range, count(*) FILTER (WHERE score_decile NOT BETWEEN 1 AND 10) AS decile_out_of_range, count(*) FILTER (WHERE actual_click NOT IN (0, 1)) AS click_not_binary, CAST(0 AS BIGINT) AS repeated_rows FROM scores")

# --- 2.10 operations and 2.11 drift ---
add("o1_latest_batch_status", lambda f: ops.latest_batch_status(f.reg), O.newest("reg", "source_file, sample_scale", "created_at DESC, batch_id DESC"))
add("o2_run_summary", lambda f: f.runsum, "SELECT * FROM runsum")
add("o3_latest_artifacts", lambda f: ops.latest_artifacts(f.of(binding.artifacts)), O.newest("(SELECT o_orderkey AS artifact_id, o_custkey % 30 + 1 AS batch_id, 'artifact_' || CAST(o_orderkey % 4 AS VARCHAR) AS artifact_name, o_orderkey % 5000 AS row_count, CAST(o_orderdate AS DATE) AS created_at FROM orders)", "batch_id, artifact_name", "created_at DESC, artifact_id DESC"))
add("o4_benchmark_summary", lambda f: f.bench, "SELECT * FROM bench")
add("o5_health", lambda f: f.health, "SELECT * FROM health")
add("o6_runtime_trend", lambda f: f.trend, "SELECT * FROM trend")
add("o7_scale_comparison", lambda f: ops.scale_comparison(f.bench, f.reg), f"SELECT b.batch_id, n.batch_name, n.sample_scale, n.source_type, b.benchmark_name, b.layer_name, b.object_name, b.row_count, b.duration_seconds, b.rows_per_second, b.storage_mb, b.recorded_at, n.completed_at FROM bench b JOIN ({O.newest('reg', 'sample_scale', 'completed_at DESC NULLS LAST, batch_id DESC')}) n USING (batch_id)")
add("o8_stage_benchmarks", lambda f: ops.stage_benchmarks(f.runsum, f.reg), "SELECT s.batch_id, s.pipeline_run_id, 'pipeline_stage_runtime' AS benchmark_name, s.layer_name, s.pipeline_name AS object_name, r.expected_row_count AS row_count, s.duration_seconds, CASE WHEN s.duration_seconds > 0 THEN CAST(round(CAST(r.expected_row_count / s.duration_seconds AS DECIMAL(18, 9)), 3) AS DOUBLE) END AS rows_per_second FROM runsum s JOIN reg r USING (batch_id) WHERE run_status = 'SUCCESS'")
add("o9_layer_counts", lambda f: ops.layer_counts({"raw": f.imp, "staging": f.stg, "warehouse": f.fact, "feature_store": f.store}), " UNION ALL ".join(f"SELECT '{n}' AS layer_name, batch_id, count(*) AS row_count FROM {t} GROUP BY batch_id" for n, t in (("raw", "imp"), ("staging", "stg"), ("warehouse", "fact"), ("feature_store", "store"))))
add("o11_kpis", lambda f: ops.kpis(f.health, f.trend), f"SELECT h.*, t.* FROM (SELECT sum(total_stage_runtime_seconds) AS total_stage_runtime, max(slowest_stage_runtime_seconds) AS slowest_stage_runtime, {J(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('total_quality_checks', 'passed_quality_checks', 'failed_quality_checks', 'warning_quality_checks', 'total_alerts', 'error_alerts', 'warning_alerts'))}, max(batch_elapsed_seconds) AS max_batch_elapsed_seconds, coalesce({O.ratio('sum(passed_quality_checks)', 'sum(total_quality_checks)')}, 0) AS quality_pass_rate FROM health) h, (SELECT round(avg(duration_seconds), 6) AS avg_stage_runtime, max(duration_seconds) AS max_stage_runtime, CAST(sum(row_count) AS BIGINT) AS rows_processed, round(avg(rows_per_second), 6) AS avg_rows_per_second FROM trend) t")
add("o12_page_extract", lambda f: f.health.select("batch_id", "batch_name", "source_file", "sample_scale", "batch_status", "batch_elapsed_seconds", "total_quality_checks", "failed_quality_checks", "total_alerts", "total_stage_runtime_seconds").orderBy(F.desc("batch_id")), "SELECT batch_id, batch_name, source_file, sample_scale, batch_status, batch_elapsed_seconds, total_quality_checks, failed_quality_checks, total_alerts, total_stage_runtime_seconds FROM health")
add("d1_metric_baseline", lambda f: f.baseline, "SELECT * FROM base")
add("d2_drift_summary", lambda f: ops.drift_summary(f.baseline), "SELECT * FROM drift")
add("d4_stage_runtime_drift", lambda f: ops.stage_runtime_drift(f.trend, f.reg), f"SELECT batch_id, batch_name, source_type, sample_scale, layer_name, object_name, row_count, duration_seconds, previous_batch_id, previous_batch_name, previous_duration_seconds, round(duration_seconds - previous_duration_seconds, 3) AS duration_delta_seconds, {O.delta_ratio('duration_seconds', 'previous_duration_seconds')} AS duration_delta_ratio, rows_per_second, previous_rows_per_second, round(rows_per_second - previous_rows_per_second, 3) AS rows_per_second_delta, recorded_at FROM (SELECT t.*, r.source_type, " + J(f"lag(t.{c}) OVER (PARTITION BY r.source_type, t.sample_scale, layer_name, object_name ORDER BY t.batch_id) AS previous_{c}" for c in ("batch_id", "batch_name", "duration_seconds", "rows_per_second")) + " FROM trend t JOIN reg r USING (batch_id))")

# --- 2.12 features ---
STORE_KEYS = ["raw_event_id", "batch_id", "label", "event_day_number", "event_batch", "click_flag", "impression_count", "click_count", "missing_numeric_count", "missing_categorical_count", "has_missing_numeric", "has_missing_categorical", "high_missingness_flag"]
LOGS = features.LOGS
WHOLE = [*STORE_KEYS, *NUMERIC, *STORED, *features.CODES, *features.BUCKET_LIFTS, *features.VALUE_LIFTS, *features.SUPPORT, "overall_ctr"]
add("f1_feature_store", lambda f: f.store.select(*WHOLE, *(F.round(c, 9).alias(c) for c in LOGS)), f"SELECT {J(WHOLE)}, {J(f'round({c}, 9) AS {c}' for c in LOGS)} FROM store")
add("f2_day_split", lambda f: f.own_split.select("raw_event_id", "event_day_number", "dataset_split"), "SELECT raw_event_id, event_day_number, dataset_split FROM split")
add("f3_encodings", lambda f: f.enc.select("column_name", "value", *(F.round(c, 9).alias(c) for c in ("smoothed_ctr", "frequency", "log_count"))), "SELECT column_name, value, round(smoothed_ctr, 9) AS smoothed_ctr, round(frequency, 9) AS frequency, round(log_count, 9) AS log_count FROM enc")
ENCODED = [f"{c}{s}" for c in features.ENCODED for s in ("_enc_ctr", "_enc_ctr_lift", "_enc_log_count")]
add("f4_apply_encodings", lambda f: features.apply_encodings(f.own_split, f.enc, f.total).select("raw_event_id", *(F.round(c, 8).alias(c) for c in ENCODED)), f"SELECT raw_event_id, {J(f'round({c}, 8) AS {c}' for c in ENCODED)} FROM encoded")
add("f5_support_logs", lambda f: f.store.select("raw_event_id", *(F.round(features.aggregates()[f"{c}_log1p"], 8).alias(f"{c}_log1p") for c in features.SUPPORT)), f"SELECT raw_event_id, {J(f'round(ln(1 + greatest({c}, 0)), 8) AS {c}_log1p' for c in features.SUPPORT)} FROM store")
add("f8_aggregates", lambda f: f.store.select("raw_event_id", *(F.round(features.aggregates()[n].cast("double"), 8).alias(n) for n in O.AGGS)), f"SELECT raw_event_id, {J(f'round(CAST({e} AS DOUBLE), 8) AS {n}' for n, e in O.AGGS.items())} FROM store")
add("f9_numbers", lambda f: f.imp.select("event_id", features.number("c1").alias("c1_number"), features.number("i2").alias("i2_number")), "SELECT event_id, coalesce(TRY_CAST(c1 AS DOUBLE), 0) AS c1_number, CAST(coalesce(i2, 0) AS DOUBLE) AS i2_number FROM imp")
FLOATS = {"i1": "i1", "bucket_lift_sum": O.AGGS["bucket_lift_sum"], "missing_ratio": O.AGGS["missing_ratio"], "c22_enc_ctr": "c22_enc_ctr", "i3_bucket_code_enc_log_count": "i3_bucket_code_enc_log_count", "c1_feature_impressions_log1p": "ln(1 + c1_feature_impressions)"}
add("f10_engineered", lambda f: features.engineered(f.split, *f.learned, ["raw_event_id"]).select("raw_event_id", *(F.round(F.col(n).cast("double"), 5).alias(n) for n in FLOATS)), f"SELECT raw_event_id, {J(f'round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 5) AS {n}' for n, e in FLOATS.items())} FROM encoded")
SCALED = ["i1", "i2", "i3", "missing_numeric_count", "c22_ctr_lift", "overall_ctr"]
add("f11_scaler", lambda f: features.scaler(f.split.where("dataset_split = 'train'"), SCALED).select("column_name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")), " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(sqrt(greatest(sum(CAST({c} AS DOUBLE) * {c}) / count(*) - avg({c}) * avg({c}), 1e-8)), 6) AS scale FROM split WHERE dataset_split = 'train'" for c in SCALED))
add("f12_scaled", lambda f: features.scale(f.own_split.select("raw_event_id", *(F.col(c).cast("double").alias(c) for c in SCALED[:3])), saved(features.scaler(f.train_rows, SCALED[:3]), "scaler"), SCALED[:3]).select("raw_event_id", *(F.round(c, 6).alias(c) for c in SCALED[:3])), "SELECT raw_event_id, " + J(f"round((s.{c} - m.m_{c}) / m.s_{c}, 6) AS {c}" for c in SCALED[:3]) + " FROM split s, (SELECT " + J(f"avg({c}) AS m_{c}, sqrt(greatest(sum(CAST({c} AS DOUBLE) * {c}) / count(*) - avg({c}) * avg({c}), 1e-8)) AS s_{c}" for c in SCALED[:3]) + " FROM split WHERE dataset_split = 'train') m")
add("f14_class_weights", lambda f: features.class_weights(f.imp).select("label", F.round("weight", 9).alias("weight")), "SELECT label, round((SELECT count(*) FROM imp) / (2e0 * count(*)), 9) AS weight FROM imp GROUP BY label")
add("f15_positive_weight", lambda f: features.positive_weight(f.imp).select(F.round("scale_pos_weight", 9).alias("scale_pos_weight")), "SELECT round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 9) AS scale_pos_weight FROM imp")

# --- 2.13 evaluation, training, scoring, promotion ---
M = ["model_id"]
add("l1_roc_auc", lambda f: evaluate.roc_auc(f.ev, M), "SELECT * FROM e_auc")
add("l2_average_precision", lambda f: evaluate.average_precision(f.ev, M), "SELECT * FROM e_ap")
add("l3_log_loss_brier", lambda f: evaluate.log_loss_brier(f.ev, M), "SELECT * FROM e_loss")
add("l4_precision_lift_at_10pct", lambda f: evaluate.at_top(f.ev, M), "SELECT * FROM e_top")
add("l5_metrics_by_model", lambda f: evaluate.evaluate(f.ev, M), "SELECT * FROM e_all")
add("t5_leaderboard", lambda f: evaluate.leaderboard(evaluate.evaluate(f.ev, M)), "SELECT * FROM e_all")


CATEGORIES = ["event_batch", *STORED, *features.CODES]
NUMBERS = [c for c in MANIFEST_COLUMNS if c not in CATEGORIES]


def _source_rows(f: Frames) -> DataFrame:
    """All source columns of the data set: numbers as doubles, categories as they are."""
    return saved(f.split.select("raw_event_id", "dataset_split", "label", *(F.col(c).cast("double").alias(c) for c in NUMBERS), *CATEGORIES), "source")


def _baseline(f: Frames) -> DataFrame:
    rows = _source_rows(f)
    model = train.fit_logistic(rows.where("dataset_split = 'train'"), NUMBERS, CATEGORIES)
    return train.score(rows.where("dataset_split != 'train'"), model, ["raw_event_id", "dataset_split", "label"])


def _logistic(f: Frames) -> DataFrame:
    """Trained in two halves: the state after half the steps is written, read and gone on from."""
    frame, names = f.ml
    own = frame.where("dataset_split = 'train'")
    state = incremental.begin(own, names, [incremental.Setting("sgd")])
    path, kept = incremental.chunked(own, state, max(1000, own.count() // 8)), f.path("state")
    incremental.fit(state, f.spark, path, 12).save(f.spark, kept)
    state = incremental.fit(incremental.State.load(f.spark, kept), f.spark, path)
    return evaluate.evaluate(incremental.scored(frame, state, ["raw_event_id", "dataset_split", "label"]).drop("config"), ["dataset_split"])


def _boosted(f: Frames) -> DataFrame:
    frame, names = f.ml
    model = train.fit_engineered(frame.where("dataset_split = 'train'"), names, "boosted", validation=frame.where("dataset_split = 'validation'"), rounds=5, depth=6)
    return evaluate.evaluate(train.score(frame, model, ["raw_event_id", "dataset_split", "label"]), ["dataset_split"])


def _tuned(f: Frames) -> DataFrame:
    frame, names = f.ml
    own = frame.where("dataset_split = 'train'")
    state = incremental.train(own, names, incremental.SETTINGS, max(1000, own.count() // 8))
    return evaluate.leaderboard(evaluate.evaluate(incremental.scored(frame.where("dataset_split = 'validation'"), state, ["raw_event_id", "label"]), ["config"]))


def _calibrated(kind: str) -> Callable[[Frames], DataFrame]:
    """Each model's scores, the later half calibrated by the earlier one; all models together."""

    def run(f: Frames) -> DataFrame:
        by = ["model_id"]
        split = saved(calibrate.halves(f.ev, by), "halves")
        fit, rest = (split.where(F.col("calibration_half") == h).drop("calibration_half") for h in ("fit", "evaluate"))
        out = calibrate.apply_sigmoid(rest, calibrate.sigmoid(fit, by), by) if kind == "sigmoid" else calibrate.apply_isotonic(rest, calibrate.isotonic(fit, by), by)
        return out.select("model_id", "raw_event_id", "label", "score", F.round("calibrated", 6).alias("calibrated"))

    return run


EV = "SELECT model_id, raw_event_id, predicted_ctr AS score, actual_click AS label, row_number() OVER (PARTITION BY model_id ORDER BY raw_event_id) - 1 < count(*) OVER (PARTITION BY model_id) // 2 AS fit FROM scores0"
CELLS = "SELECT model_id, score, count(*) AS n, sum(label) AS clicks FROM halved WHERE fit GROUP BY 1, 2"
CURVE = "1 / (1 + exp(-(slope * score + intercept)))"


def _newton(steps: int = 12) -> str:
    """Newton's steps one after another, from a flat curve."""
    parts = ["c0 AS (SELECT DISTINCT model_id, 0e0 AS slope, 0e0 AS intercept FROM cells)"]
    for k in range(steps):
        parts.append(f"g{k} AS (SELECT model_id, slope, intercept, sum((n * p - clicks) * score) + slope AS ga, sum(n * p - clicks) AS gb, sum(n * p * (1 - p) * score * score) + 1 AS haa, sum(n * p * (1 - p) * score) AS hab, sum(n * p * (1 - p)) AS hbb FROM (SELECT *, {CURVE} AS p FROM cells JOIN c{k} USING (model_id)) GROUP BY model_id, slope, intercept)")
        parts.append(f"c{k + 1} AS (SELECT model_id, slope - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS slope, intercept - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS intercept FROM g{k})")
    return ", ".join(parts)


SIGMOID = f"WITH halved AS ({EV}), cells AS ({CELLS}), {_newton()} SELECT model_id, raw_event_id, label, score, round({CURVE}, 6) AS calibrated FROM halved JOIN c12 USING (model_id) WHERE NOT fit"
# The best rising function at place i is the largest over beginnings a <= i of the least over ends b >= i of the rate from a to b.
ISOTONIC = f"""WITH halved AS ({EV}), cells AS ({CELLS}), sums AS (SELECT model_id, score, row_number() OVER w AS i, sum(n) OVER w AS n, sum(clicks) OVER w AS clicks, n AS own_n, clicks AS own_clicks FROM cells WINDOW w AS (PARTITION BY model_id ORDER BY score)),
spans AS (SELECT a.model_id, a.i AS a, b.i AS b, min((b.clicks - a.clicks + a.own_clicks)::DOUBLE / (b.n - a.n + a.own_n)) OVER (PARTITION BY a.model_id, a.i ORDER BY b.i DESC) AS least FROM sums a JOIN sums b ON a.model_id = b.model_id AND a.i <= b.i),
fitted AS (SELECT s.model_id, s.score, m.rate FROM (SELECT model_id, b AS i, max(least) AS rate FROM spans GROUP BY 1, 2) m JOIN sums s USING (model_id, i)),
lower_of AS (SELECT e.*, f.score AS s0, f.rate AS r0 FROM (SELECT DISTINCT model_id, score FROM halved WHERE NOT fit) e ASOF LEFT JOIN fitted f ON e.model_id = f.model_id AND e.score >= f.score),
near AS (SELECT l.*, f.score AS s1, f.rate AS r1 FROM lower_of l ASOF LEFT JOIN fitted f ON l.model_id = f.model_id AND l.score <= f.score)
SELECT e.model_id, e.raw_event_id, e.label, e.score, round(CASE WHEN s0 IS NULL THEN r1 WHEN s1 IS NULL OR s0 = s1 THEN r0 ELSE r0 + (r1 - r0) * (e.score - s0) / (s1 - s0) END, 6) AS calibrated FROM halved e JOIN near USING (model_id, score) WHERE NOT fit"""


def _trees_onehot(f: Frames) -> DataFrame:
    rows = _source_rows(f)
    own = train.with_positive_weight(rows.where("dataset_split = 'train'"))
    prepared = train.fit_encoder(own, NUMBERS, CATEGORIES)
    model = train.boosted(rounds=5, depth=6).fit(prepared.transform(train.dealt(own, train.width_of(prepared, own))))
    return train.score(prepared.transform(rows.where("dataset_split != 'train'")), model, ["raw_event_id", "dataset_split", "label"])


add("l6_logistic_baseline", _baseline)
add("l7_logistic_engineered", _logistic)
add("l8_boosted_onehot", _trees_onehot)
add("l9_boosted_engineered", _boosted)
add("l10_tuning", _tuned)
add("l11_sigmoid_calibration", _calibrated("sigmoid"), SIGMOID)
add("l12_isotonic_calibration", _calibrated("isotonic"), ISOTONIC)
add("l14_scored_batch", lambda f: f.scores.select("raw_event_id", "model_id", "training_run_id", "predicted_ctr", "actual_click", "score_decile", "is_top_decile"), "SELECT raw_event_id, model_id, training_run_id, predicted_ctr, actual_click, score_decile, is_top_decile FROM scores")
add("l15_score_summary", lambda f: evaluate.score_summary(f.scores, ["model_id"]), "SELECT model_id, count(*) AS row_count, round(avg(predicted_ctr), 6) AS avg_predicted_ctr, round(avg(actual_click), 6) AS actual_ctr, count(*) FILTER (WHERE is_top_decile) AS top_decile_row_count, round(avg(actual_click) FILTER (WHERE is_top_decile), 6) AS top_decile_actual_ctr, round(avg(predicted_ctr) FILTER (WHERE is_top_decile), 6) AS top_decile_avg_predicted_ctr FROM scores GROUP BY model_id")
add("l16_model_lookup", lambda f: train.find_model(f.models, f.truns, "model_1").select("model_id", "model_version", "training_run_id", "completed_at"), "SELECT model_id, model_version, training_run_id, completed_at FROM models JOIN truns USING (model_id) WHERE model_name = 'model_1' AND model_status = 'READY' AND is_active_canonical AND run_status = 'SUCCESS' ORDER BY completed_at DESC NULLS LAST, training_run_id DESC LIMIT 1")
add("l17_importance", lambda f: importance.importance(f.coef, ["model_id", "training_run_id"]), "SELECT * FROM imp0")


def _decided(f: Frames) -> DataFrame:
    return promote.review(f.models, f.truns, f.mcomp, "v4")[1]


def _promoted(f: Frames) -> DataFrame:
    """Several models of a name are active before; the one that stays is what candidates are held against."""
    registry, decided = promote.review(_several_active(f), f.truns, f.mcomp, "v4")
    return promote.apply(registry, decided, F.lit("2024-06-01").cast("date")).select("model_id", "model_name", "is_active_canonical", "canonical_promoted_at")


CAND = "SELECT DISTINCT m.model_id, c.model_name, c.model_version, c.training_run_id, c.rows_trained, c.validation_roc_auc, c.validation_pr_auc, c.validation_lift_at_10pct FROM mcomp c JOIN models m USING (model_name, model_version)"
MET = ["validation_roc_auc", "validation_pr_auc", "validation_lift_at_10pct"]


def _rule(then: Callable[[str, str], str]) -> str:
    return " ".join(
        f"WHEN {c} THEN {then(yes, why)}"
        for c, yes, why in (
            ("c.rows_trained < 500000", "false", "Candidate run is not large-scale enough for canonical promotion."),
            (" OR ".join(f"c.{m} IS NULL" for m in MET), "false", "Candidate run does not have complete validation and ranking metrics."),
            ("c.model_version <> 'v4' AND b.model_name IS NOT NULL AND b.training_run_id <> c.training_run_id AND " + " AND ".join(f"coalesce(b.{m}, 0) >= c.{m}" for m in MET), "false", "Scheduled candidate does not beat the canonical base version on ROC-AUC, PR-AUC, and lift."),
            ("a.model_name IS NULL", "true", "No active canonical model exists yet; promoting the first large-scale qualified model."),
            ("a.training_run_id = c.training_run_id", "false", "Candidate is already the active canonical training run."),
            ("c.model_version = 'v4' AND a.model_version <> 'v4' AND " + " AND ".join(f"abs(c.{m} - coalesce(a.{m}, 0)) < 1e-9" for m in MET), "true", "Candidate matches the scheduled clone on metrics and reclaims the canonical base version slot."),
            (" AND ".join(f"c.{m} >= coalesce(a.{m}, 0) + {by}" for m, by in zip(MET, ("0.005e0", "0.005e0", "0.05e0"))), "true", "Candidate exceeded the active canonical model on ROC-AUC, PR-AUC, and lift thresholds."),
        )
    )


WHY = "concat_ws('; ', " + J(f"CASE WHEN c.{m} >= coalesce(a.{m}, 0) + {by} THEN NULL ELSE '{n} threshold not met' END" for m, by, n in zip(MET, ("0.005e0", "0.005e0", "0.05e0"), ("ROC-AUC", "PR-AUC", "lift"))) + ") || '.'"
def _decide(active: str) -> str:
    return f"SELECT c.*, CASE {_rule(lambda yes, why: yes)} ELSE false END AS promoted, CASE {_rule(lambda yes, why: chr(39) + why + chr(39))} ELSE {WHY} END AS decision_reason FROM ({CAND}) c LEFT JOIN (SELECT * FROM ({active}) WHERE training_run_id IS NOT NULL) a ON a.model_name = c.model_name LEFT JOIN ({O.newest(f'({CAND} WHERE c.model_version = {chr(39)}v4{chr(39)})', 'model_name', 'training_run_id DESC')}) b ON b.model_name = c.model_name"


add("l20_promotion", _decided, _decide("active1"))
# The active models after normalising, with their newest successful runs.
ACTIVE = f"SELECT DISTINCT m.model_name, m.model_version, t.run AS training_run_id, c.validation_roc_auc, c.validation_pr_auc, c.validation_lift_at_10pct FROM models m JOIN ({ONE_ACTIVE}) o USING (model_id) LEFT JOIN (SELECT model_id, max(training_run_id) AS run FROM truns WHERE run_status = 'SUCCESS' GROUP BY 1) t USING (model_id) JOIN mcomp c ON c.model_name = m.model_name AND c.model_version = m.model_version AND c.training_run_id = t.run"
add("l22_apply_promotion", _promoted, f"SELECT m.model_id, m.model_name, CASE WHEN w.model_id IS NULL THEN o.model_id IS NOT NULL ELSE m.model_id = w.model_id END AS is_active_canonical, CASE WHEN m.model_id = w.model_id THEN DATE '2024-06-01' ELSE m.canonical_promoted_at END AS canonical_promoted_at FROM models m LEFT JOIN ({ONE_ACTIVE}) o USING (model_id) LEFT JOIN (SELECT model_name, max_by(model_id, training_run_id) AS model_id FROM ({_decide(ACTIVE)}) WHERE promoted GROUP BY 1) w ON w.model_name = m.model_name")

# --- 2.14 monitoring ---
add("n1_latest_training_metrics", lambda f: monitor.latest_training_metrics(f.models, f.truns, f.tmetrics), "SELECT model_name, model_version, training_run_id, run_status, dataset_split, roc_auc, pr_auc, log_loss, precision_at_10pct, lift_at_10pct, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version, dataset_split ORDER BY recorded_at DESC, metric_id DESC) AS rk FROM models JOIN truns USING (model_id) JOIN tmetrics USING (training_run_id)) WHERE rk = 1")
add("n2_decile_performance", lambda f: monitor.decile_performance(f.scores, f.reg), f"SELECT s.*, r.batch_name FROM (SELECT {O.IDS}, score_decile, count(*) AS rows_scored, round(avg(predicted_ctr), 6) AS avg_predicted_ctr, round(avg(actual_click), 6) AS actual_ctr, round(avg(predicted_ctr) - avg(actual_click), 6) AS calibration_gap FROM scores GROUP BY ALL) s JOIN reg r USING (batch_id)")
add("n3_top_decile_performance", lambda f: f.perf, "SELECT * FROM perf")
add("n4_score_drift", lambda f: f.sdrift, "SELECT * FROM sdrift")
add("n5_model_comparison", lambda f: f.mcomp, "SELECT * FROM mcomp")
add("n6_latest_dashboard", lambda f: f.dash, "SELECT * FROM dash")
add("n7_active_dashboard", lambda f: monitor.active_dashboard(f.dash), "SELECT * FROM dash WHERE is_active_canonical")
RUN1 = "(SELECT DISTINCT model_name, model_version, training_run_id, training_scale_band, is_canonical_1m_run, validation_roc_auc, validation_pr_auc, validation_precision_at_10pct, validation_lift_at_10pct FROM mcomp)"
add("n8_batch_rankings", lambda f: monitor.batch_rankings(f.perf, f.mcomp), f"SELECT p.batch_id, p.model_id, p.training_run_id, p.model_name, p.model_version, p.batch_name, p.rows_scored, p.overall_actual_ctr, p.top_decile_rows, p.top_decile_actual_ctr, p.top_decile_lift_vs_batch_ctr, r.training_scale_band, r.is_canonical_1m_run, r.validation_roc_auc, r.validation_pr_auc, r.validation_precision_at_10pct, r.validation_lift_at_10pct, dense_rank() OVER (PARTITION BY p.batch_id ORDER BY p.top_decile_lift_vs_batch_ctr DESC NULLS FIRST, r.validation_roc_auc DESC NULLS FIRST) AS batch_rank_by_lift, dense_rank() OVER (PARTITION BY p.batch_id ORDER BY r.validation_roc_auc DESC NULLS FIRST, p.top_decile_lift_vs_batch_ctr DESC NULLS FIRST) AS batch_rank_by_auc FROM perf p LEFT JOIN {RUN1} r USING (model_name, model_version, training_run_id)")
add("n9_drift_watchlist", lambda f: f.watch, "SELECT * FROM watch")
add("n10_latest_importance", lambda f: f.limp, "SELECT * FROM limp")
add("n11_group_importance", lambda f: monitor.group_importance(f.limp), "SELECT model_name, model_version, training_run_id, feature_group, count(*) AS features_in_group, round(sum(abs_importance_value), 8) AS total_abs_importance, round(avg(abs_importance_value), 8) AS avg_abs_importance, round(max(abs_importance_value), 8) AS max_abs_importance, round(sum(relative_importance_pct), 6) AS group_relative_importance_pct FROM limp GROUP BY ALL")
add("n12_active_canonical", lambda f: f.active, "SELECT * FROM active")
add("n13_kpis", lambda f: monitor.kpis(f.dash, f.watch, f.limp), "SELECT d.*, w.*, i.* FROM (SELECT max(validation_roc_auc) AS best_validation_roc_auc, max(validation_pr_auc) AS best_validation_pr_auc, max(top_decile_lift_vs_batch_ctr) AS best_top_decile_lift, count(*) FILTER (WHERE is_canonical_1m_run) AS canonical_model_count, max(validation_roc_auc) FILTER (WHERE is_active_canonical) AS active_validation_roc_auc, max(validation_pr_auc) FILTER (WHERE is_active_canonical) AS active_validation_pr_auc, max(top_decile_lift_vs_batch_ctr) FILTER (WHERE is_active_canonical) AS active_top_decile_lift, count(*) FILTER (WHERE promotion_status = 'eligible') AS promotion_eligible_count FROM dash) d, (SELECT count(*) FILTER (WHERE drift_status = 'investigate') AS investigate_drift_count FROM watch) w, (SELECT round(sum(relative_importance_pct), 6) AS feature_relative_importance_pct FROM limp) i")
add("n14_page_extract", lambda f: f.watch.select("batch_id", "model_name", "model_version", "drift_status", "drift_note", "top_decile_lift_delta").orderBy(F.desc("batch_id"), "model_name", "model_version"), "SELECT batch_id, model_name, model_version, drift_status, drift_note, top_decile_lift_delta FROM watch")

# --- 2.15 sampling ---
SIZES = {"small": 100, "medium": 250, "large": 500}
TARGETS = "SELECT s.sample_name, l.label, CASE WHEN l.label = 1 THEN s.size - z ELSE z END AS target FROM (SELECT *, least(size - least(CAST(round_even(size * n1 / (n0 + n1), 0) AS BIGINT), n1, size), n0) AS z FROM (VALUES ('small', 100), ('medium', 250), ('large', 500)) v(sample_name, size), (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM imp)) s, (VALUES (0), (1)) l(label)"
SAMPLES = f"SELECT e.event_id, t.sample_name, e.label FROM (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7|', CAST(event_id AS VARCHAR))), event_id) AS r FROM imp) e JOIN ({TARGETS}) t ON t.label = e.label AND e.r <= t.target"
add("k1_targets", lambda f: sampling.targets(f.imp, SIZES), f"SELECT sample_name, label, CAST(target AS BIGINT) AS target FROM ({TARGETS})")
add("k3_nested_samples", lambda f: sampling.nested_samples(f.imp, SIZES).select("event_id", "sample_name", "label"), SAMPLES)


def _written(f: Frames) -> DataFrame:
    path = f.path("samples")
    sampling.write_samples(sampling.nested_samples(f.imp.select("event_id", "label", "c22"), SIZES), path)
    return f.spark.read.schema("event_id long, label int, c22 string, sample_name string").option("header", True).csv(path).select("event_id", "sample_name", "label")


add("k4_sample_files", _written, SAMPLES)
add("k5_sample_summary", lambda f: sampling.summary(sampling.nested_samples(f.imp.select("event_id", "label"), SIZES)), f"SELECT sample_name, count(*) AS row_count, count(*) FILTER (WHERE label = 1) AS clicks, count(*) FILTER (WHERE label = 0) AS non_clicks, round(avg(label), 6) AS ctr FROM ({SAMPLES}) GROUP BY 1")
add("a25_stratum_sizes", lambda f: sampling.stratum_sizes(f.imp), "SELECT label, count(*) AS row_count FROM imp GROUP BY 1")


# --- 2.16 streaming ---
def inbox_of(f: Frames, folders: dict[str, int]) -> str:
    """An inbox with a folder for each name, with a file of that batch's rows."""
    inbox = f.path("inbox")
    source = f.imp.select("batch_id", "label", *(F.col(c).alias(c.upper()) for c in NUMERIC), *(F.nullif(F.col(c), F.lit("")).alias(c.upper()) for c in CATEGORICAL))
    write = lambda folder: source.where(F.col("batch_id") == folders[folder]).drop("batch_id").coalesce(1).write.option("header", True).csv(f"{inbox}/{folder}")
    with ThreadPoolExecutor(len(folders)) as pool:  # a file is one task's; the files are written at once
        list(pool.map(write, folders))
    return inbox


def _streamed(f: Frames) -> DataFrame:
    """Two inboxes, each with a checkpoint of its own, bring three contents into one store, one of them in both and twice in the first: the marts hold
    each content once."""
    from adloom.streaming import intake

    store = f.path("store")
    for folders in ({"1": 1, "2": 2, "3": 1}, {"1": 3, "2": 1}):
        intake.run(f.spark, f"{inbox_of(f, folders)}/*", store, f.path("checkpoint"))
    return intake.table(f.spark, store, "marts/overall").select("impressions", "clicks", "ctr", "avg_missing_numeric_count", "avg_missing_categorical_count")


add("x1_file_intake", _streamed, "SELECT impressions, clicks, ctr, avg_missing_numeric_count, avg_missing_categorical_count FROM b_overall WHERE batch_id IN (1, 2, 3)")


from adloom.plans import single  # noqa: E402, F401  (registers the queries of single operators)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which feature buckets do better or worse than the whole?"""
    return QUERIES["m9_numeric_bucket_ctr"](spark, sf_dir)
