"""Expected values of single operators, and what holds for those that SQL can't express."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.operators import evaluate, features, importance, promote, quality, ranks, sampling, staging, tables, train
from adloom.sources import binding, files

SF = "/root/testdata/sf0.001"


def test_deciles_of_few_and_many(spark):
    few = spark.createDataFrame([(i, s) for i, s in enumerate([0.95, 0.80, 0.60, 0.20, 0.10])], "raw_event_id long, predicted_ctr double")
    assert [r.score_decile for r in evaluate.with_deciles(few, []).orderBy("raw_event_id").collect()] == [10, 8, 6, 4, 2]
    many = spark.createDataFrame([(i, 20.0 - i) for i in range(20)], "raw_event_id long, predicted_ctr double")
    got = [r.score_decile for r in evaluate.with_deciles(many, []).orderBy("raw_event_id").collect()]
    assert set(got) == set(range(1, 11)) and got[0] == 10 and got[-1] == 1


def test_score_summary(spark):
    rows = [("a", 0.9, 1, True), ("a", 0.8, 1, True), ("a", 0.3, 0, False), ("a", 0.1, 0, False), ("b", 0.2, 0, False)]
    got = {r.m: r for r in evaluate.score_summary(spark.createDataFrame(rows, "m string, predicted_ctr double, actual_click int, is_top_decile boolean"), ["m"]).collect()}
    assert (got["a"].row_count, got["a"].top_decile_row_count, got["a"].actual_ctr, got["a"].top_decile_actual_ctr) == (4, 2, 0.5, 1.0)
    assert (got["b"].top_decile_row_count, got["b"].top_decile_actual_ctr) == (0, 0.0)


def test_precision_and_lift_of_the_top_tenth(spark):
    rows = [(i, y, 1.0 - i / 10) for i, y in enumerate([1, 0, 1, 0, 0, 1, 0, 0, 0, 0])]
    got = evaluate.at_top(spark.createDataFrame(rows, "raw_event_id long, label int, score double"), []).first()
    assert got.precision_at_10pct == 1.0 and got.lift_at_10pct > 1


@pytest.mark.parametrize("scores", [[0.1, 0.4, 0.35, 0.8], [0.5, 0.5, 0.5, 0.5], [0.9, 0.9, 0.1, 0.1]])
def test_auc_counts_pairs(spark, scores):
    labels = [0, 0, 1, 1]
    pairs = [(p, n) for p, y in zip(scores, labels) if y for n, z in zip(scores, labels) if not z]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    df = spark.createDataFrame([("m", s, y) for s, y in zip(scores, labels)], "m string, score double, label int")
    assert evaluate.roc_auc(df, ["m"]).first().roc_auc == pytest.approx(want)


def test_distributed_ranks_and_tiles_are_the_window_functions(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 501).alias("k"))
    w = Window.partitionBy("g").orderBy("k")
    both = ranks.ranked(df, ["g"], [F.asc("k")]).withColumn("want", F.row_number().over(w) - 1)
    assert both.where("rank0 != want").count() == 0
    for k in (1, 4, 7, 200):
        tiled = both.withColumn("tile", ranks.ntile_of(F.col("rank0"), F.col("total"), k)).withColumn("n", F.ntile(k).over(w))
        assert tiled.where("tile != n").count() == 0
    sums = ranks.running_sums(df.withColumn("v", F.col("k")), ["g"], "k", ["v"])
    want = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert sums.withColumn("want", want).where("v_before != want").count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 6, 7, 8, 50])
def test_event_days_of_small_files(spark, n):
    raw = spark.range(n).select((F.col("id") * 3).alias("event_id"), F.lit("f").alias("source_file"))
    a = {r.event_id: r.event_day_number for r in staging.with_event_day(raw).collect()}
    assert a == {r.event_id: r.event_day_number for r in staging.with_event_day_window(raw).collect()}


def test_day_sets():
    assert features.parse_days("1,2,5") == {1, 2, 5}
    for bad in ("0,8", ""):
        with pytest.raises(ValueError):
            features.parse_days(bad)
    with pytest.raises(ValueError):
        features.split_lookup(frozenset({1, 2}), frozenset({2, 6}), frozenset({7}))


@pytest.mark.parametrize(("labels", "ratio"), [([1, 0, 0, 1, 0, 0], 2.0), ([0, 0], 1.0), ([1, 1], 1.0)])
def test_positive_weight(spark, labels, ratio):
    df = spark.createDataFrame([(y,) for y in labels], "label int")
    assert features.positive_weight(df).first().scale_pos_weight == ratio


def test_feature_groups(spark):
    names = {"missing_ratio": "missingness", "i1_log_scale": "numeric_log", "i3_bucket_code_enc_ctr": "bucket_signal", "c1_enc_ctr": "target_encoding", "event_day_x_bucket_lift_mean": "bucket_signal", "i7": "numeric_raw", "overall_ctr": "context"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.g for r in df.select("n", importance.feature_group(F.col("n")).alias("g")).collect()} == names


def test_scale_and_batch_name(spark):
    df = spark.createDataFrame([("events_100k.csv", "x"), ("live_batch.csv", "x"), ("Live Batch-01.csv", "abcdef1234567890")], "f string, c string")
    got = df.select(tables.sample_scale(F.col("f")).alias("s"), tables.batch_name(F.col("f"), F.col("c")).alias("n")).collect()
    assert [r.s for r in got[:2]] == ["100k", "incoming"] and got[2].n == "live_batch_01_abcdef123456"


M = "model_name string, model_version string, training_run_id long, rows_trained long, validation_roc_auc double, validation_pr_auc double, validation_lift_at_10pct double, model_id long"


def test_promotion_decisions(spark):
    base = ("m", "v4", 1, 700_000, 0.75, 0.53, 2.5, 1)
    candidates = [
        ("m", "v5", 9, 700_000, 0.80, 0.60, 3.0, 9),
        ("m", "v6", 10, 700_000, 0.752, 0.531, 2.6, 10),
        ("m", "v7", 11, 700_000, 0.75, 0.53, 2.5, 11),
        ("m", "v8", 12, 100, 0.9, 0.9, 9.0, 12),
        ("m", "v9", 13, 700_000, None, 0.9, 9.0, 13),
        ("new", "v1", 14, 700_000, 0.6, 0.3, 1.5, 14),
        base,
    ]
    df = spark.createDataFrame(candidates, M)
    one = spark.createDataFrame([base], M)
    got = {r.model_version: (r.promoted, r.decision_reason) for r in promote.decide(df, one, one, "v4").collect()}
    assert got["v5"][0] and got["v1"][0] and "exceeded" in got["v5"][1] and "first" in got["v1"][1]
    assert got["v6"] == (False, "ROC-AUC threshold not met; PR-AUC threshold not met.")
    assert not got["v7"][0] and "does not beat" in got["v7"][1] and "large-scale" in got["v8"][1] and "complete" in got["v9"][1] and "already" in got["v4"][1]
    clone = spark.createDataFrame([("m", "clone", 5, 700_000, 0.75, 0.53, 2.5, 5)], M)
    again = {r.model_version: r for r in promote.decide(df.where("model_version = 'v4'"), clone, one, "v4").collect()}
    assert again["v4"].promoted and "reclaims" in again["v4"].decision_reason


def test_apply_promotion_leaves_one_active(spark):
    registry = spark.createDataFrame([(1, "m", "v1", True, None, None), (2, "m", "v2", False, None, None), (3, "k", "v1", True, None, "old")], "model_id long, model_name string, model_version string, is_active_canonical boolean, canonical_promoted_at date, canonical_promotion_note string")
    decided = spark.createDataFrame([("m", 2, 7, True, "better")], "model_name string, model_id long, training_run_id long, promoted boolean, decision_reason string")
    got = {r.model_id: r for r in promote.apply(registry, decided, F.lit("2024-01-01").cast("date")).collect()}
    assert not got[1].is_active_canonical and got[2].is_active_canonical and got[2].canonical_promotion_note == "better" and got[3].canonical_promotion_note == "old"


def test_expressions_of_edges(spark):
    df = spark.createDataFrame([(None, None, "  "), (-5, 1, ""), (0, 0, "x"), (10_001, 5, None)], "n int, y int, c string")
    got = df.select(X.bucket_code(X.fill_numeric("n")).alias("b"), X.clean_label("y").alias("y"), X.fill_categorical("c").alias("c"), X.fill_categorical("c", True).alias("t"), X.ratio("y", "n").alias("r")).collect()
    assert [r.b for r in got] == ["zero", "negative", "zero", "10001_plus"] and [r.y for r in got] == [0, 1, 0, 0]
    assert [r.c for r in got] == ["  ", "unknown", "x", "unknown"] and [r.t for r in got] == ["unknown", "unknown", "x", "unknown"]
    assert got[0].r is None and got[2].r is None


def test_replacing_a_batch_twice_gives_the_same_table(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 2).alias("batch_id"))
    path = f"file://{tmp_path}/t"
    tables.replace_batch(df, path)
    for _ in range(2):
        tables.replace_batch(df.where("batch_id = 1"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(20))


def test_upsert_keeps_what_the_newest_lacks(spark):
    s = "k long, v long, a string, b string"
    got = tables.upsert(spark.createDataFrame([(1, 1, "x", "y"), (2, 1, "o", None)], s), spark.createDataFrame([(1, 2, None, "z")], s), ["k"], "v", ["a"])
    assert {tuple(r) for r in got.collect()} == {(1, 2, "x", "z"), (2, 1, "o", None)}


def test_content_digest_ignores_order(spark):
    df = spark.range(100).withColumn("f", F.lit("a"))
    one = tables.content_digest(df, ["f"], ["id"]).first().digest
    assert one == tables.content_digest(df.repartition(7).orderBy(F.rand(1)), ["f"], ["id"]).first().digest
    assert one != tables.content_digest(df.where("id > 0"), ["f"], ["id"]).first().digest


def test_samples_are_nested_and_exact(spark):
    rows = binding.impressions(spark, SF).select("event_id", "label")
    got = {}
    for r in sampling.nested_samples(rows, {"s": 50, "m": 100, "l": 300}).collect():
        got.setdefault(r.sample_name, set()).add(r.event_id)
    assert {k: len(v) for k, v in got.items()} == {"s": 50, "m": 100, "l": 300} and got["s"] <= got["m"] <= got["l"]


def test_load_mismatch_fails(spark):
    rows = binding.impressions(spark, SF)
    expected = rows.groupBy("batch_id").agg((F.count(F.lit(1)) + 1).alias("expected_row_count"))
    with pytest.raises(ValueError):
        files.require_match(files.reconcile(rows, expected))


def test_engineered_features_have_no_nulls(spark):
    from adloom.plans.queries import Frames

    f = Frames(spark, SF)
    frame, names = f.ml
    bad = frame.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in names)).first()
    assert sum(bad) == 0 and {"c22_enc_ctr", "bucket_lift_mean", "missing_ratio"} <= set(names)
    stats = features.scaler(frame, names[:5])
    scaled = features.scale(frame, stats, names[:5]).agg(*(F.avg(c).alias(c) for c in names[:5])).first()
    assert all(abs(x) < 1e-3 for x in scaled)


def test_calibration(spark):
    rows = binding.prediction_scores(spark, SF).where("model_id = 1").select("raw_event_id", F.col("predicted_ctr").alias("score"), F.col("actual_click").alias("label"))
    for kind in ("sigmoid", "isotonic"):
        fitted, rest = train.calibrate(rows, kind)
        got = fitted.apply(rest).orderBy("score").collect()
        values = [r.calibrated for r in got]
        assert all(0 <= v <= 1 for v in values) and all(a <= b + 1e-12 for a, b in zip(values, values[1:]))
    with pytest.raises(ValueError):
        train.calibrator(rows, "other")


def test_models_find_the_planted_signal(spark):
    from adloom.plans.queries import Frames

    frame, names = Frames(spark, "/root/testdata/sf0.01").ml
    own = [n for n in names if n.startswith("c22") or n.startswith("i1_")]
    for kind, options in (("logistic", {"reg": 1e-3}), ("boosted", {"rounds": 3, "depth": 3})):
        model = train.fit_engineered(frame.where("dataset_split = 'train'"), own, kind, **options)
        scored = train.score(frame.where("dataset_split = 'test'"), model, ["raw_event_id", "label"])
        assert scored.where("score < 0 or score > 1").count() == 0
        assert evaluate.roc_auc(scored.withColumn("m", F.lit("m")), ["m"]).first().roc_auc > 0.55


def test_streaming_takes_each_content_once(spark):
    from adloom.plans.queries import QUERIES

    got = QUERIES["x1_file_intake"](spark, SF).collect()
    rows = binding.impressions(spark, SF)
    assert sorted(r.impressions for r in got) == sorted(r["count"] for r in rows.groupBy("batch_id").count().collect())


def test_places_in_groups_of_any_size_are_the_window_functions(spark):
    """Half of all rows share one value, so runs of equal values go over many tasks."""
    from pyspark.sql import Window

    rows = [(g, (0 if i % 2 else i % 7) if i % 11 else None, i % 5, i) for g in "ab" for i in range(300 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, x int, y int, id long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = ranks.placed(df, ["g"], [F.desc_nulls_first("x"), F.desc("y"), F.asc("id")], ["x", "y"], ["x"], ("y",)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    w = Window.partitionBy("g").orderBy(F.desc_nulls_first("x"), F.desc("y"), F.asc("id"))
    want = df.select("*", (F.row_number().over(w) - 1).alias("rank0"), F.count("id").over(Window.partitionBy("g")).alias("total"), F.dense_rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("x"), F.desc("y"))).alias("dense"), F.sum("y").over(w).alias("y_so_far"), F.count("id").over(Window.partitionBy("g").orderBy(F.desc_nulls_first("x"))).alias("tie_end"))
    key = lambda r: tuple(str(r[c]) for c in ("g", "x", "y", "id", "rank0", "total", "dense", "y_so_far", "tie_end"))
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))


def test_numbers_of_rows_have_no_gaps(spark):
    for n in (1, 5):
        got = ranks.numbered(spark.range(0, 103, 1, n).withColumnRenamed("id", "x"), "k", 1000).orderBy("k").collect()
        assert [(r.k, r.x) for r in got] == [(1000 + i, i) for i in range(103)]
    assert ranks.numbered(spark.range(0), "k").count() == 0


def test_content_digest_counts_nulls_and_their_places(spark):
    rows = [("a", "x", None), ("b", None, "x"), ("c", None, None), ("d", "", None), ("e", "x", None), ("f", "x", None), ("f", "x", None)]
    got = {r.s: r.digest for r in tables.content_digest(spark.createDataFrame(rows, "s string, u string, v string"), ["s"], ["u", "v"]).collect()}
    assert got["a"] == got["e"] and len(set(got.values())) == 5


def test_lookups_beyond_a_broadcast_find_the_same(spark, monkeypatch):
    """Frequent, rare, unknown and null values, looked up by a broadcast and by narrow rows."""
    frame = spark.createDataFrame([(i, "unknown" if i % 3 else f"v{i}", None if i % 5 == 0 else f"w{i % 4}") for i in range(200)], "id long, a string, b string")
    table = frame.unpivot(["id"], ["a", "b"], "feature_name", "feature_value").where("feature_value is not null and feature_value != 'v9'").groupBy("feature_name", "feature_value").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    columns = {"a": F.col("a"), "b": F.col("b")}
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("id", "a", "b", "_a_last", "_b_last").collect())
    small = key(features.looked_up(frame, "id", table, columns, ["last"]))
    monkeypatch.setattr(features, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(features, "HOT", 20)
    assert key(features.looked_up(frame, "id", table, columns, ["last"])) == small and len(small) == 200


def test_samples_take_the_least_digests_whatever_the_bound(spark):
    import hashlib

    rows = [(i, int(i % 9 == 0)) for i in range(3000)]
    got = {}
    for r in sampling.nested_samples(spark.createDataFrame(rows, "event_id long, label int"), {"s": 40, "l": 300, "all": 5000}).collect():
        got.setdefault(r.sample_name, set()).add(r.event_id)
    place = lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i)
    for name, size in (("s", 40), ("l", 300)):
        ones = round(size * 334 / 3000)
        want = {i for label, n in ((1, ones), (0, size - ones)) for i in sorted((i for i, y in rows if y == label), key=place)[:n]}
        assert got[name] == want
    assert got["all"] == set(range(3000))


def test_logistic_models_are_at_their_optimum(spark):
    """The gradient of the weighted, penalised loss is near zero at the fitted coefficients."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] - 1)))).astype(int)
    frame = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int")
    model = train.fit_engineered(frame, ["a", "b", "c"], "logistic", reg=0.01)
    beta, intercept = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    wrong = weight * (1 / (1 + np.exp(-(x @ beta + intercept))) - y) / weight.sum()
    assert np.abs(x.T @ wrong + 0.01 * beta).max() < 1e-3 and abs(wrong.sum()) < 1e-3
    scored = train.score(frame, model, ["label"])
    curve = train.calibrator(scored, "sigmoid")
    rows = curve.apply(scored).collect()
    wrong = np.array([r.calibrated - r.label for r in rows])
    assert abs(wrong.mean()) < 1e-3 and abs((wrong * [r.score for r in rows]).mean()) < 1e-3
    chained = train.score(frame, model, ["label"], "p", curve).collect()
    assert sorted(r.p for r in chained) == pytest.approx(sorted(r.calibrated for r in rows))


def test_isotonic_calibration_pools_adjacent_violators(spark):
    import random

    rng = random.Random(3)
    rows = [(i / 60, int(rng.random() < i / 60)) for i in range(60)]
    blocks = []
    for score, label in rows:
        blocks.append([label, 1, [score]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + scores]
    want = {s: total / n for total, n, scores in blocks for s in scores}
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r.score: r.calibrated for r in train.calibrator(df, "isotonic").apply(df).collect()}
    assert got == pytest.approx(want)


def csv_of(folder, name, values, label=1):
    from adloom.streaming import intake

    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("label," + ",".join(intake.COLUMNS) + "\n" + "".join(f"{label}," + ",".join([str(v)] * 39) + "\n" for v in values))


def batch_at(spark, *paths):
    from adloom.streaming import intake

    return spark.read.schema(intake.source_schema()).option("header", True).csv([str(p) for p in paths]).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def test_failed_batches_are_registered_and_taken_in_again(spark, tmp_path, monkeypatch):
    from adloom.streaming import intake

    csv_of(tmp_path / "in", "a.csv", range(5))
    batch, store = batch_at(spark, tmp_path / "in"), str(tmp_path / "store")
    broken = intake.marts.batch_overall
    monkeypatch.setattr(intake.marts, "batch_overall", lambda fact: fact.select("nothing"))
    with pytest.raises(Exception):
        intake.process(batch, 0, store)
    assert [r.batch_status for r in intake.registry(spark, store).collect()] == ["FAILED"]
    assert intake.table(spark, store, "staging").count() == 0  # written, but not committed
    monkeypatch.setattr(intake.marts, "batch_overall", broken)
    assert [intake.process(batch, i, store) for i in (1, 2)] == [1, 0]
    ids = [r.raw_event_id for r in intake.table(spark, store, "staging").collect()]
    assert sorted(ids) == [2 * files.BATCH_IDS + i for i in range(5)]


def test_two_checkpoints_lose_nothing(spark, tmp_path):
    from adloom.streaming import intake

    csv_of(tmp_path / "one", "a.csv", range(30))
    csv_of(tmp_path / "two", "a.csv", range(100, 150))
    store = str(tmp_path / "store")
    for name in ("one", "two"):
        intake.run(spark, str(tmp_path / name), store, str(tmp_path / f"checkpoint_{name}"))
    rows = intake.table(spark, store, "staging")
    assert rows.count() == 80 and rows.select("raw_event_id").distinct().count() == 80 and rows.select("batch_id").distinct().count() == 2


def test_equal_files_of_one_name_and_replayed_epochs(spark, tmp_path):
    from adloom.streaming import intake

    for folder in ("a", "b"):
        csv_of(tmp_path / folder, "same.csv", range(30))
    batch, store = batch_at(spark, tmp_path / "a", tmp_path / "b"), str(tmp_path / "store")
    assert [intake.process(batch, 0, store, "q"), intake.process(batch, 0, store, "q"), intake.process(batch, 0, store, "other")] == [1, 0, 0]
    assert intake.table(spark, store, "staging").count() == 30
    statuses = [r.batch_status for r in intake.registry(spark, store).collect()]
    assert sorted(statuses) == ["DUPLICATE", "DUPLICATE", "DUPLICATE", "QUALITY_CHECKED"]


def test_every_processed_file_is_archived(spark, tmp_path):
    from adloom.streaming import intake

    inbox, archive, failed = tmp_path / "in", tmp_path / "archive", tmp_path / "failed"
    for n in range(3):
        csv_of(inbox, f"f{n}.csv", range(n * 10, n * 10 + 10))
    csv_of(archive, "f0.csv", [7])  # its name is taken there
    store = str(tmp_path / "store")
    intake.run(spark, str(inbox), store, str(tmp_path / "checkpoint"), str(archive), str(failed))
    assert not list(inbox.glob("*.csv")) and sorted(p.name for p in archive.glob("*.csv")) == ["f0.csv", "f0_1.csv", "f1.csv", "f2.csv"]
    got = intake.registry(spark, store).collect()
    assert {r.batch_status for r in got} == {"ARCHIVED"} and sorted(r.archive_path.rsplit("/", 1)[1] for r in got) == ["f0_1.csv", "f1.csv", "f2.csv"]
    csv_of(inbox, "later.csv", range(90, 95))
    intake.run(spark, str(inbox), store, str(tmp_path / "checkpoint"), str(archive), str(failed))
    assert intake.table(spark, store, "staging").count() == 35 and not list(inbox.glob("*.csv"))


def test_a_commit_is_one_writers(spark, tmp_path):
    from adloom.sources.commits import CommitLog

    one, two = CommitLog(spark, f"{tmp_path}/log"), CommitLog(spark, f"{tmp_path}/log")
    entry = {"batch_id": 1, "query": "q", "epoch": 0, "digest": "d", "source_path": "p", "source_file": "f", "row_count": 1, "batch_status": "STARTED"}
    asked = []

    def decide(states):
        asked.append(states.count())
        if len(asked) == 1:
            two.append(lambda _: [entry | {"batch_id": 9}])  # another writer is faster
        return [entry | {"batch_id": states.count() + 1}]

    assert [r["commit"] for r in one.append(decide)] == [2] and asked == [0, 1]
    assert sorted(r.batch_id for r in two.states().collect()) == [2, 9] and two.last() == 2
    assert one.append(lambda states: []) == [] and one.last() == 2


def test_the_active_model_that_stays_is_the_best_one(spark):
    """A stronger model stays before the base version; the base version only decides between equals."""
    registry = spark.createDataFrame([(1, "m", "v4", True, None, None), (2, "m", "v5", True, None, None), (3, "k", "v4", True, None, None), (4, "k", "v6", True, "2024-01-01", None), (5, "s", "v1", True, None, None), (6, "s", "v2", False, None, None)], "model_id long, model_name string, model_version string, is_active_canonical boolean, canonical_promoted_at string, canonical_promotion_note string")
    runs = spark.createDataFrame([(1, 11, "SUCCESS"), (2, 12, "SUCCESS"), (2, 13, "FAILED"), (3, 14, "SUCCESS"), (4, 15, "SUCCESS")], "model_id long, training_run_id long, run_status string")
    compared = spark.createDataFrame([("m", "v4", 11, 0.70, 0.5, 2.0, 600_000), ("m", "v5", 12, 0.80, None, 2.0, 600_000), ("k", "v4", 14, 0.7, 0.5, 2.0, 600_000), ("k", "v6", 15, 0.7, 0.5, 2.0, 600_000)], "model_name string, model_version string, training_run_id long, validation_roc_auc double, validation_pr_auc double, validation_lift_at_10pct double, rows_trained long")
    got = {r.model_id for r in promote.normalise(registry, runs, compared, "v4").where("is_active_canonical").collect()}
    assert got == {2, 3, 5}


def test_missing_values_are_zero_and_unknown(spark):
    from pyspark.ml.functions import vector_to_array

    rows = [(1.0, "a"), (None, None), (3.0, "a"), (float("nan"), "unknown"), (5.0, "b")]
    df = spark.createDataFrame(rows, "x double, c string").withColumn("one", F.lit(2.0))
    model = train.fit_encoder(df, ["x", "one"], ["c"])
    got = [r.v for r in model.transform(df).select(vector_to_array("features").alias("v")).collect()]
    x = np.array([1, 0, 3, 0, 5.0])
    assert np.allclose([v[0] for v in got], (x - x.mean()) / x.std()) and all(v[1] == 0 for v in got)
    assert got[1][2:] == got[3][2:] and all(sum(v[2:]) == 1 for v in got) and len(got[0]) == 5
    unseen = model.transform(spark.createDataFrame([(1.0, "new", 2.0)], "x double, c string, one double")).select(vector_to_array("features").alias("v")).first().v
    assert sum(unseen[2:]) == 0


def test_calibration_of_several_models_at_once(spark):
    from adloom.operators import calibrate

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for model, n in ((1, 400), (2, 60), (3, 1), (4, 5)):
        score = np.round(rng.random(n), 2)
        label = (rng.random(n) < score**model).astype(int) if model != 4 else np.ones(n, int)
        rows += [(model, i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))]
        want[model] = (score, label)
    df = spark.createDataFrame(rows, "model_id long, raw_event_id long, score double, label int").repartition(5)
    blocks = {}
    for r in calibrate.isotonic(df, ["model_id"]).orderBy("model_id", "lo").collect():
        blocks.setdefault(r.model_id, []).append(r)
    for model, (score, label) in want.items():
        values = np.unique(score)
        n, s = np.array([(score == v).sum() for v in values]), np.array([label[score == v].sum() for v in values])
        best = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
        own = [next(b.clicks / b.n for b in blocks[model] if b.lo <= v <= b.hi) for v in values]
        assert np.allclose(own, best)
        asked = [(model, float(x), 0) for x in np.linspace(-0.2, 1.2, 29)]
        got = {r.score: r.calibrated for r in calibrate.apply_isotonic(spark.createDataFrame(asked, "model_id long, score double, label int"), calibrate.isotonic(df, ["model_id"]), ["model_id"]).collect()} if model < 3 else {}
        assert all(abs(got[x] - np.interp(x, values, best)) < 1e-9 for x in got)
    curves = {r.model_id: r for r in calibrate.sigmoid(df, ["model_id"]).collect()}
    for model in (1, 2):
        score, label = want[model]
        p = 1 / (1 + np.exp(-(curves[model].slope * score + curves[model].intercept)))
        assert abs((p - label).sum()) < 1e-6 and abs(((p - label) * score).sum() + curves[model].slope) < 1e-6


def test_training_in_two_halves_is_training_at_once(spark, tmp_path):
    from adloom.operators import incremental

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    frame = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)], "label int, a double, b double, c double")
    columns, settings = ["a", "b", "c"], [incremental.Setting("two", epochs=2), incremental.Setting("three", l1=0.5, alpha=1e-3)]
    state = incremental.begin(frame, columns, settings)
    path = incremental.chunked(frame, state, 1000)
    at_once = incremental.fit(state, spark, path)
    incremental.fit(state, spark, path, 4).save(spark, f"{tmp_path}/state")
    again = incremental.fit(incremental.State.load(spark, f"{tmp_path}/state"), spark, path)
    assert again == at_once and at_once.done == 9 and at_once.history == [1000] * 9
    two = incremental.fit(incremental.begin(frame, columns, settings[:1]), spark, path)
    assert np.allclose(two.weights[0], at_once.weights[0])  # a setting doesn't depend on those beside it, nor on their epochs
    got = incremental.scored(frame, at_once, ["label"]).groupBy("config").agg(F.corr("label", "score").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2 and all(r.r > 0.5 and r.n == 3000 for r in got)


def test_observed_metrics_are_those_of_the_table(spark):
    seen = quality.Observer()
    df = spark.range(100).select(F.col("id").alias("raw_event_id"), (F.col("id") % 3).alias("click_flag"), F.lit(1).alias("click_count"), F.lit(1).alias("impression_count"))
    written = seen.write(df, "staging", quality.staging_metrics())
    assert seen.of(spark, "staging").first().asDict() == written.agg(*quality.staging_metrics()).first().asDict()
    twice = written.unionByName(written.where("raw_event_id < 5"))
    assert quality.duplicates({"one": written, "two": twice}).first().asDict() == {"one": 0, "two": 5}


def test_a_keyed_table_rewrites_the_buckets_it_touches(spark, tmp_path):
    from adloom.sources.keyed import KeyedTable

    table = KeyedTable(spark, f"{tmp_path}/t", "k long, v long, a string", ["k"], 64)
    put = lambda old, new: tables.upsert(old, new, ["k"], "v")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"), F.lit("old").alias("a"))
    assert table.read().count() == 0 and table.change(rows, put) == 64
    before = table.read()
    assert table.change(rows.where("k in (5, 6)").select("k", (F.col("v") + 1).alias("v"), F.lit("new").alias("a")), put) in (1, 2)
    assert before.where("a = 'new'").count() == 0 and {r.k for r in table.read().where("a = 'new'").collect()} == {5, 6}
    assert table.read().count() == 1000 and table.drop_old() in (1, 2) and table.read().count() == 1000
    once = []

    def late(old, new):
        if not once:  # another change of the same bucket comes between
            once.append(KeyedTable(spark, f"{tmp_path}/t", table.schema, ["k"], 64).change(spark.createDataFrame([(5, 9, "between")], table.schema), put))
        return put(old, new)

    table.change(spark.createDataFrame([(5, 7, "late")], table.schema), late)
    assert [r.a for r in table.read().where("k = 5").collect()] == ["between"]
    table.change(None, lambda old, _: old.where("k >= 990"))
    assert table.read().count() == 10


def test_runs_and_metrics_are_joined_by_a_shuffle(spark):
    """Both grow with the runs, so neither goes through the driver, however small its files."""
    from adloom.operators import monitor

    sf = "/root/testdata/sf0.001"
    models, runs, metrics = (one(spark, sf) for one in (binding.model_registry, binding.training_runs, binding.model_metrics))
    for made in (monitor.metric_pivot(models, runs, metrics), monitor.latest_training_metrics(models, runs, metrics)):
        made.count()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert any("SortMergeJoin [training_run_id" in line for line in plan.splitlines())
        assert made.select("training_run_id").distinct().count() > 1


def test_events_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """The file is cut into more parts than there are cores, and its one row group is in one of them."""
    monkeypatch.setattr(binding, "TASK_ROWS", 1000)
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.sha2(F.col("id").cast("string"), 512).alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(binding, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").repartition(4, F.lit(1)))  # four parts, of which one has rows
    sizes = [r.n for r in binding.events(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 15 and max(sizes) < 2500


def test_training_rows_are_dealt_by_the_size_of_their_vectors(spark, monkeypatch):
    monkeypatch.setattr(train, "TASK_NUMBERS", 10_000)
    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("label")).coalesce(1)
    parts = train.dealt(rows, 100)
    sizes = [r.n for r in parts.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert parts.rdd.getNumPartitions() == 40 and sum(sizes) == 4000 and max(sizes) < 300


def test_shards_are_bounded_and_read_whole(spark, monkeypatch):
    from adloom.operators import incremental

    monkeypatch.setattr(incremental, "SHARD_NUMBERS", 200)
    frame = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("a"))
    state = incremental.begin(frame, ["a"], [incremental.Setting("one", epochs=1)])
    path = incremental.chunked(frame, state, 1000)
    shards = spark.read.parquet(path).select("shard", F.col("_metadata.file_path").alias("path")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files")).collect()
    assert len(shards) == 10 and all(r.n == 100 and r.files == 1 for r in shards)
    assert incremental.fit(state, spark, path).history == [1000]


def test_short_lookups_are_literals_and_take_no_join(spark, monkeypatch):
    """A map, a broadcast and a shuffle find the same, absent and null values too; what isn't read isn't looked up."""
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y"), (4, "none", "x")], "id long, p string, q string")
    table = spark.createDataFrame([("p", "a", 2, 0.5), ("p", "b", 3, None), ("q", "x", 4, 1.5)], "feature_name string, feature_value string, n long, rate double")
    columns = {c: F.col(c) for c in ("p", "q", "id_text")}
    frame = frame.withColumn("id_text", F.col("id").cast("string"))
    rows = lambda df: sorted(map(str, df.select("id", "_p_rate", "_q_rate", "_id_text_rate").collect()))
    found = features.looked_up(frame, "id", table, columns, ["rate"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    short = rows(found)
    monkeypatch.setattr(features, "MAP_ROWS", 0)
    assert rows(features.looked_up(frame, "id", table, columns, ["rate"])) == short
    monkeypatch.setattr(features, "BROADCAST_ROWS", 0)
    assert rows(features.looked_up(frame, "id", table, columns, ["rate"])) == short


def test_a_task_reads_a_bounded_part_of_wide_tables(spark):
    from adloom.sources import work

    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        work.compiled(spark)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == work.TASK_BYTES
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        work.compiled(spark)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_encodings_come_from_sums_of_days(spark):
    """Encodings and the global rate from day sums are those learned from the rows, and a store needs lifts of its own columns only."""
    from adloom.operators import marts
    from adloom.plans.queries import LOOKUP, STORED, Frames

    f = Frames(spark, SF)
    days = [features.with_split(d, LOOKUP).where("dataset_split = 'train'") for d in (f.d_bucket, f.d_stored)]
    got, total = features.encodings_of(*days)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, features.encodings(f.train_rows).select(*got.columns).collect()))
    assert total.first() == features.global_ctr(f.train_rows).first()
    assert {r[0] for r in f.d_stored.select("feature_name").distinct().collect()} == set(STORED)
    own = marts.lifts(f.d_stored, f.m_overall)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, f.m_feature.where(F.col("feature_name").isin(STORED)).select(*own.columns).collect()))
    assert sorted(map(tuple, f.b_bucket.collect())) == sorted(map(tuple, marts.batch_numeric_bucket(f.stg).collect()))


def test_wide_steps_sort_and_shuffle_no_rows_twice(spark):
    """Batches are counted without a sort of the facts, the hour of an event is computed once, and where tiles begin is found without a shuffle of all ids."""
    from adloom.operators import marts

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(i % 3, f"f{i % 2}", "full", i % 2, i % 5, i % 7) for i in range(60)]
    fact = spark.createDataFrame(rows, "batch_id long, source_file string, event_batch string, click_count int, missing_numeric_count int, missing_categorical_count int")
    got = {r.batch_id: r for r in marts.batch_overall(fact).collect()}
    for b, r in got.items():
        own = [x for x in rows if x[0] == b]
        assert (r.source_file, r.impressions, r.clicks, r.avg_missing_numeric_count) == ("f1", 20, sum(x[3] for x in own), round(sum(x[4] for x in own) / 20, 6))
    first = plan(marts.batch_overall(spark.range(9).selectExpr("id batch_id", "'f' || id source_file", "'full' event_batch", "1 click_count", "1 missing_numeric_count", "1 missing_categorical_count")))
    assert first.rindex("HashAggregate") > first.rindex("SortAggregate") if "SortAggregate" in first else True
    assert plan(binding.impressions(spark, SF)).count("hour(") == 1
    starts = ranks.tile_starts(spark.range(70).selectExpr("'a' f", "id"), ["f"], "id", 7)
    assert starts.first().starts == [10, 20, 30, 40, 50, 60] and "BroadcastHashJoin" in plan(starts)
