"""Click-through-rate marts: sums for each batch, and the same over all batches with lift, bands and ranks.

Rates are never averaged: a batch mart holds impressions and clicks, and what is read across batches is computed from their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import CATEGORICAL, HIGH, MEDIUM, MEDIUM_BUCKET, NUMERIC, UNKNOWN, BUCKETS
from adloom.operators.ranks import placed, ranges
from adloom.operators.warehouse import unpivot

MEASURES = ["impressions", "clicks", "ctr"]


def _measures(clicks: str = "click_count") -> list[Column]:
    return [F.count(F.lit(1)).alias("impressions"), F.sum(clicks).alias("clicks"), X.ratio(F.sum(clicks), F.count(F.lit(1))).alias("ctr")]


def batch_overall(fact: DataFrame) -> DataFrame:
    """Rows are counted by file first: the largest of strings among all rows would need them sorted."""
    totals = ["missing_numeric_count", "missing_categorical_count"]
    files = fact.groupBy("batch_id", "source_file", "event_batch").agg(F.count(F.lit(1)).alias("n"), F.sum("click_count").alias("c"), *(f(c).alias(f"{c}_{k}") for c in totals for k, f in (("sum", F.sum), ("n", F.count))))
    n, clicks = F.sum("n"), F.sum("c")
    return files.groupBy("batch_id").agg(F.max("source_file").alias("source_file"), F.max("event_batch").alias("event_batch"), n.alias("impressions"), clicks.alias("clicks"), X.ratio(clicks, n).alias("ctr"), *(X.ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"avg_{c}") for c in totals))


def batch_event_day(fact: DataFrame, days: DataFrame) -> DataFrame:
    sums = fact.groupBy("batch_id", "event_day_key").agg(*_measures())
    return sums.join(F.broadcast(days), "event_day_key").select("batch_id", "event_batch", "event_day_number", "day_label", *MEASURES)


def _bucket_names(code: Column, at: int) -> Column:
    return F.create_map(*(F.lit(x) for b in BUCKETS for x in (b[0], b[at])))[code]


def day_buckets(staged: DataFrame) -> DataFrame:
    """(batch_id, event_day_number, feature_name, feature_value, impressions, clicks), a value being a bucket's code: of these sums are batches' and
    days', such as those that encodings learn from. One scan, 13 rows an event before partial aggregation."""
    long = unpivot(staged, NUMERIC, ["batch_id", "event_day_number", "click_count"])
    return long.groupBy("batch_id", "event_day_number", "feature_name", X.bucket_code("feature_value").alias("feature_value")).agg(*_measures()[:2])


def day_values(staged: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """The same of the values of categorical columns."""
    long = unpivot(staged, columns, ["batch_id", "event_day_number", "click_count"])
    return long.groupBy("batch_id", "event_day_number", "feature_name", "feature_value").agg(*_measures()[:2])


def bucket_sums(days: DataFrame) -> DataFrame:
    """The mart of batches and buckets from `day_buckets`; labels are put on at most 91 rows a batch."""
    sums = _summed(days.withColumnRenamed("feature_value", "bucket_code"), ["batch_id", "feature_name", "bucket_code"])
    return sums.select("batch_id", "feature_name", "bucket_code", _bucket_names(F.col("bucket_code"), 1).alias("bucket_label"), _bucket_names(F.col("bucket_code"), 2).alias("bucket_order"), *MEASURES)


def lifts(days: DataFrame, total: DataFrame) -> DataFrame:
    """(feature_name, feature_value, impressions, clicks, ctr, overall_ctr, ctr_lift_vs_overall) from `day_values`: what the feature store reads of `feature`,
    which also ranks values."""
    return _against(_summed(days, ["feature_name", "feature_value"]), total)


def batch_numeric_bucket(staged: DataFrame) -> DataFrame:
    """One scan, 13 rows an event before partial aggregation; labels are put on afterwards, to at most 91 rows a batch."""
    long = unpivot(staged, NUMERIC, ["batch_id", "click_count"])
    sums = long.groupBy("batch_id", "feature_name", X.bucket_code("feature_value").alias("bucket_code")).agg(*_measures())
    return sums.select("batch_id", "feature_name", "bucket_code", _bucket_names(F.col("bucket_code"), 1).alias("bucket_label"), _bucket_names(F.col("bucket_code"), 2).alias("bucket_order"), *MEASURES)


def batch_feature(staged: DataFrame) -> DataFrame:
    long = unpivot(staged, CATEGORICAL, ["batch_id", "click_count"])
    return long.groupBy("batch_id", "feature_name", "feature_value").agg(*_measures()).withColumn("is_unknown", F.col("feature_value") == UNKNOWN).select("batch_id", "feature_name", "feature_value", "is_unknown", *MEASURES)


def batch_missing(fact: DataFrame) -> DataFrame:
    long = fact.unpivot(["batch_id", "click_count"], ["missing_numeric_count", "missing_categorical_count"], "missing_type", "missing_count")
    return long.groupBy("batch_id", "missing_type", "missing_count").agg(*_measures())


def _interaction(staged: DataFrame, name: str, left: str, left_value: Column, right: str) -> DataFrame:
    sums = staged.groupBy("batch_id", left_value.alias("left_feature_value"), F.col(right).alias("right_feature_value")).agg(*_measures())
    return sums.select("batch_id", F.lit(name).alias("interaction_name"), F.lit(left).alias("left_feature_name"), "left_feature_value", F.lit(right).alias("right_feature_name"), "right_feature_value", *MEASURES)


def interaction_c22_c19(staged: DataFrame) -> DataFrame:
    return _interaction(staged, "categorical_pair_c22_c19", "c22", F.col("c22"), "c19")


def interaction_c22_c6(staged: DataFrame) -> DataFrame:
    return _interaction(staged, "categorical_pair_c22_c6", "c22", F.col("c22"), "c6")


def interaction_i1_c22(staged: DataFrame) -> DataFrame:
    return _interaction(staged, "numeric_categorical_i1_c22", "i1_bucket", X.bucket_code("i1"), "c22")


def batch_interactions(staged: DataFrame) -> DataFrame:
    """The three interactions. Each staged row becomes three rows of (name, left, right) in one scan, which are summed together."""
    triples = F.array(
        *(
            F.struct(F.lit(n).alias("interaction_name"), F.lit(a).alias("left_feature_name"), v.alias("left_feature_value"), F.lit(b).alias("right_feature_name"), F.col(b).alias("right_feature_value"))
            for n, a, v, b in (("categorical_pair_c22_c19", "c22", F.col("c22"), "c19"), ("categorical_pair_c22_c6", "c22", F.col("c22"), "c6"), ("numeric_categorical_i1_c22", "i1_bucket", X.bucket_code("i1"), "c22"))
        )
    )
    long = staged.select("batch_id", "click_count", F.inline(triples))
    keys = ["batch_id", "interaction_name", "left_feature_name", "left_feature_value", "right_feature_name", "right_feature_value"]
    return long.groupBy(*keys).agg(*_measures())


# --- over all batches ---


def overall(b_overall: DataFrame) -> DataFrame:
    """One row: the rate over all batches, and mean counts of missing values weighted by impressions."""
    n = F.sum("impressions")
    weighted = lambda c: X.ratio(F.sum(F.col(c) * F.col("impressions")), n)
    return b_overall.agg(n.alias("impressions"), F.sum("clicks").alias("clicks"), X.ratio(F.sum("clicks"), n).alias("ctr"), weighted("avg_missing_numeric_count").alias("avg_missing_numeric_count"), weighted("avg_missing_categorical_count").alias("avg_missing_categorical_count")).select(F.lit("all_loaded_batches").alias("scope_name"), "*")


def _summed(mart: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return mart.groupBy(*keys).agg(*more, F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), X.ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"))


def _against(mart: DataFrame, total: DataFrame) -> DataFrame:
    """Adds the overall rate, a table of one row, and the lift over it."""
    return mart.crossJoin(F.broadcast(total.select(F.col("ctr").alias("overall_ctr")))).withColumn("ctr_lift_vs_overall", X.lift("ctr", "overall_ctr"))


def _dense(partition: list[str], *order: Column) -> Column:
    return F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))


def _ranked(mart: DataFrame, group: str, order: list[Column], by: list[str], name: str, n: int) -> DataFrame:
    """The same for groups of any number of values, such as those of a feature."""
    return placed(mart, [group], order, by, n=n).withColumn(name, F.col("dense").cast("int")).drop("rank0", "total", "dense")


def event_day(b_day: DataFrame) -> DataFrame:
    sums = _summed(b_day, ["event_batch", "event_day_number", "day_label"])
    return sums.withColumn("ctr_rank_in_batch", _dense(["event_batch"], F.desc_nulls_first("ctr"))).withColumn("impression_rank_in_batch", _dense(["event_batch"], F.desc("impressions")))


def numeric_bucket(b_bucket: DataFrame, total: DataFrame, high: int = HIGH, medium: int = MEDIUM_BUCKET) -> DataFrame:
    sums = _against(_summed(b_bucket, ["feature_name", "bucket_code", "bucket_label", "bucket_order"]), total)
    return sums.withColumn("volume_band", X.volume_band("impressions", high, medium)).withColumn("ctr_rank_in_feature", _dense(["feature_name"], F.desc_nulls_first("ctr"))).withColumn("impression_rank_in_feature", _dense(["feature_name"], F.desc("impressions")))


def feature(b_feature: DataFrame, total: DataFrame, high: int = HIGH, medium: int = MEDIUM) -> DataFrame:
    sums = _against(_summed(b_feature, ["feature_name", "feature_value"], F.bool_or("is_unknown").alias("is_unknown")), total)
    sums, n = sums.withColumn("volume_band", X.volume_band("impressions", high, medium)), ranges(b_feature)
    ranked = _ranked(sums, "feature_name", [F.desc_nulls_first("ctr"), F.desc("impressions")], ["ctr", "impressions"], "ctr_rank_in_feature", n)
    return _ranked(ranked, "feature_name", [F.desc("impressions"), F.desc_nulls_first("ctr")], ["impressions", "ctr"], "impression_rank_in_feature", n)


def missing(b_missing: DataFrame, total: DataFrame) -> DataFrame:
    return _against(_summed(b_missing, ["missing_type", "missing_count"]), total)


def interactions(b_inter: DataFrame, total: DataFrame, high: int = HIGH, medium: int = MEDIUM) -> DataFrame:
    keys = ["interaction_name", "left_feature_name", "left_feature_value", "right_feature_name", "right_feature_value"]
    sums = _against(_summed(b_inter, keys), total).withColumn("volume_band", X.volume_band("impressions", high, medium))
    return _ranked(sums, "interaction_name", [F.desc_nulls_first("ctr"), F.desc("impressions")], ["ctr", "impressions"], "ctr_rank_in_interaction", ranges(b_inter))


def top(mart: DataFrame, rank: str, least: int, n: int = 5) -> DataFrame:
    """The rows of a mart with at least `least` impressions that are among the first n ranks."""
    return mart.where((F.col("impressions") >= least) & (F.col(rank) <= n))
