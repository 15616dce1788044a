"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import math

import pytest

from __spark_entry__ import entry
from adloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = ["s14_upsert", "s16_retention", "s21_run_states", "p3_categorical_fill", "p8_staging", "a3_batch_numeric_bucket", "a5_batch_missing", "m1_dim_event_day", "m9_numeric_bucket_ctr", "m10_feature_ctr", "m12_feature_interaction_ctr", "m13_feature_ranked", "m14_event_day_rolling", "m15_high_value_segments", "m16_low_performing_segments", "m17_feature_lift_ranked", "m18_feature_interaction_ranked", "w1_event_day_distributed", "w18_score_deciles", "q8_full_run", "q10_validation_dashboard", "o2_run_summary", "o5_health", "o7_scale_comparison", "d2_drift_summary", "d4_stage_runtime_drift", "f3_encodings", "f8_aggregates", "f11_scaler", "l5_metrics_by_model", "l17_importance", "l20_promotion", "n1_latest_training_metrics", "n4_score_drift", "n6_latest_dashboard", "n8_batch_rankings", "k1_targets", "k3_nested_samples"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (bool, int, float)):
        return f"{float(value):.5g}"
    return str(value)[:19] if hasattr(value, "year") else str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    own = lambda columns, rows: sorted((tuple(v for _, v in sorted(zip(columns, row), key=lambda x: x[0])) for row in rows), key=lambda row: [*(plain(v) for v in row if not isinstance(v, float)), *(plain(v) for v in row)])
    mine, theirs = own(df.columns, got), own(names, result.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(plain(x) == plain(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-7) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLE) <= set(QUERIES)


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-2]) >= len(QUERIES) and out.stdout.split()[-1] == "True"
