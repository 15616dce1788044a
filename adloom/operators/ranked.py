"""Ranked and rolling marts of each batch, many batches together. Values of a feature and pairs of an interaction may be any number, so their
ranks don't come from windows, which would sort a feature in one task, but from ranges of the order; windows are over days only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions import exprs as X
from adloom.functions.columns import HIGH, INTERACTION_MIN, MEDIUM, MEDIUM_BUCKET, SEGMENT_MIN
from adloom.operators.ranks import ntile_of, placed, ranges, ranked


def _against(mart: DataFrame, b_overall: DataFrame) -> DataFrame:
    """Adds the batch's overall rate (one row a batch) and the lift over it."""
    return mart.join(b_overall.select("batch_id", F.col("ctr").alias("overall_ctr")), "batch_id").withColumn("ctr_lift_vs_overall", X.lift("ctr", "overall_ctr"))


def _over(keys: list[str], *order: Column) -> Window:
    return Window.partitionBy("batch_id", *keys).orderBy(*order)


def feature_ranked(b_feature: DataFrame, b_overall: DataFrame, high: int = HIGH, medium: int = MEDIUM) -> DataFrame:
    """Row number, dense rank, percent rank (ascending) and quartile of each value within its feature; ties in the quartile go by value."""
    f = _against(b_feature, b_overall).withColumn("volume_band", X.volume_band("impressions", high, medium))
    best = [F.desc_nulls_first("ctr"), F.desc("impressions")]
    p = placed(f, ["batch_id", "feature_name"], [*best, F.asc("feature_value")], ["ctr", "impressions"], ["ctr"], n=ranges(b_feature))
    return p.select(*f.columns, (F.col("rank0") + 1).cast("int").alias("row_number_in_feature"), F.col("dense").cast("int").alias("dense_rank_in_feature"), _percent().alias("percent_rank_in_feature"), ntile_of(F.col("rank0"), F.col("total"), 4).alias("ctr_quartile_in_feature"))


def _percent() -> Column:
    """percent_rank by ascending rate (nulls last) of rows in descending order: the rows behind the last one of the same rate are those before
    it the other way."""
    return F.round(F.coalesce(F.try_divide(F.col("total") - F.col("tie_end"), F.col("total") - 1), F.lit(0.0)), 6)


def event_day_rolling(b_day: DataFrame) -> DataFrame:
    """Change from the day before, running totals, and the mean and weighted rate of three days."""
    w = _over(["event_batch"], F.asc("event_day_number"))
    to_now, three = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    before = F.lag("ctr").over(w)
    clicks, shown = F.sum("clicks").over(to_now), F.sum("impressions").over(to_now)
    return b_day.select(
        "*",
        F.round(before, 6).alias("previous_day_ctr"),
        F.round(F.col("ctr") - before, 6).alias("ctr_change_from_previous_day"),
        shown.alias("cumulative_impressions"),
        clicks.alias("cumulative_clicks"),
        X.ratio(clicks, shown).alias("cumulative_ctr"),
        F.round(F.avg("ctr").over(three), 6).alias("rolling_3_day_avg_ctr"),
        X.ratio(F.sum("clicks").over(three), F.sum("impressions").over(three)).alias("rolling_3_day_weighted_ctr"),
    )


def _segments(b_feature: DataFrame, b_bucket: DataFrame, b_inter: DataFrame, b_overall: DataFrame, high: int, medium: int, medium_bucket: int) -> DataFrame:
    """The three families of segments in one table."""

    def part(mart: DataFrame, kind: str, name: str, value: Column, medium: int) -> DataFrame:
        return mart.select("batch_id", F.lit(kind).alias("segment_type"), F.col(name).alias("segment_name"), value.alias("segment_value"), "impressions", "clicks", "ctr", X.volume_band("impressions", high, medium).alias("volume_band"))

    pair = F.concat("left_feature_value", F.lit(" x "), "right_feature_value")
    union = part(b_feature, "categorical_feature_value", "feature_name", F.col("feature_value"), medium)
    union = union.unionByName(part(b_bucket, "numeric_feature_bucket", "feature_name", F.col("bucket_label"), medium_bucket))
    return _against(union.unionByName(part(b_inter, "feature_interaction", "interaction_name", pair, medium)), b_overall)


def high_value_segments(b_feature, b_bucket, b_inter, b_overall, least: int = SEGMENT_MIN, least_pair: int = INTERACTION_MIN, over: float = 0.05, high: int = HIGH, medium: int = MEDIUM, medium_bucket: int = MEDIUM_BUCKET) -> DataFrame:
    """Segments of enough impressions whose rate is well over the batch's, ranked by lift and by clicks."""
    s = _segments(b_feature, b_bucket, b_inter, b_overall, high, medium, medium_bucket)
    enough = F.when(F.col("segment_type") == "feature_interaction", least_pair).otherwise(least)
    s = s.where((F.col("impressions") >= enough) & (F.col("ctr_lift_vs_overall") > over))
    return s.select("*", F.dense_rank().over(_over(["segment_type"], F.desc("ctr_lift_vs_overall"), F.desc("impressions"))).alias("segment_rank_by_lift"), F.dense_rank().over(_over(["segment_type"], F.desc("clicks"), F.desc("impressions"))).alias("segment_rank_by_clicks"))


def low_performing_segments(b_feature, b_bucket, b_inter, b_overall, least: int = SEGMENT_MIN, least_pair: int = INTERACTION_MIN, under: float = -0.05, under_pair: float = -0.02, high: int = HIGH, medium: int = MEDIUM, medium_bucket: int = MEDIUM_BUCKET) -> DataFrame:
    s = _segments(b_feature, b_bucket, b_inter, b_overall, high, medium, medium_bucket)
    pair = F.col("segment_type") == "feature_interaction"
    s = s.where((F.col("impressions") >= F.when(pair, least_pair).otherwise(least)) & (F.col("ctr_lift_vs_overall") < F.when(pair, under_pair).otherwise(under)))
    return s.select("*", F.dense_rank().over(_over(["segment_type"], F.asc("ctr_lift_vs_overall"), F.desc("impressions"))).alias("segment_rank_by_underperformance"), F.dense_rank().over(_over(["segment_type"], F.desc("impressions"), F.asc("clicks"))).alias("segment_rank_by_volume"))


def lift_ranked(b_feature: DataFrame, b_bucket: DataFrame, b_overall: DataFrame, high: int = HIGH, medium: int = MEDIUM, medium_bucket: int = MEDIUM_BUCKET) -> DataFrame:
    """Features and buckets ranked by lift within each feature, with quintiles over the whole family; ties go by name and value."""
    values = b_feature.select("batch_id", F.lit("categorical_feature").alias("feature_family"), "feature_name", F.col("feature_value").alias("segment_value"), "impressions", "clicks", "ctr", X.volume_band("impressions", high, medium).alias("volume_band"))
    buckets = b_bucket.select("batch_id", F.lit("numeric_bucket").alias("feature_family"), "feature_name", F.col("bucket_label").alias("segment_value"), "impressions", "clicks", "ctr", X.volume_band("impressions", high, medium_bucket).alias("volume_band"))
    s = _against(values.unionByName(buckets), b_overall)
    best = [F.desc_nulls_first("ctr_lift_vs_overall"), F.desc("impressions")]
    p = placed(s, ["batch_id", "feature_family", "feature_name"], [*best, F.asc("segment_value")], ["ctr_lift_vs_overall", "impressions"], n=ranges(b_feature))
    p = p.select(*s.columns, (F.col("rank0") + 1).cast("int").alias("row_number_by_lift"), F.col("dense").cast("int").alias("dense_rank_by_lift"))
    whole = ranked(p, ["batch_id", "feature_family"], [*best, F.asc("feature_name"), F.asc("segment_value")], ranges(b_feature))
    return whole.withColumn("lift_quintile", ntile_of(F.col("rank0"), F.col("total"), 5)).drop("rank0", "total")


def interaction_ranked(b_inter: DataFrame, b_overall: DataFrame, high: int = HIGH, medium: int = MEDIUM) -> DataFrame:
    s = _against(b_inter, b_overall).withColumn("volume_band", X.volume_band("impressions", high, medium))
    best = [F.desc_nulls_first("ctr"), F.desc("impressions")]
    values = [F.asc("left_feature_value"), F.asc("right_feature_value")]
    group = ["batch_id", "interaction_name"]
    n = ranges(b_inter)
    p = placed(s, group, [*best, *values], ["ctr", "impressions"], ["ctr"], n=n)
    p = p.select(*s.columns, (F.col("rank0") + 1).cast("int").alias("row_number_in_interaction"), F.col("dense").cast("int").alias("dense_rank_in_interaction"), _percent().alias("percent_rank_in_interaction"))
    sums = placed(p, group, [F.desc("clicks"), F.desc("impressions"), *values], ["clicks"], None, ("clicks",), n)
    return sums.withColumnRenamed("clicks_so_far", "cumulative_clicks_by_interaction").drop("rank0", "total", "dense")
