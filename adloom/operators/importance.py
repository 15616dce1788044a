"""What a model's coefficients say: size, share, direction, feature group and a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_group(name: Column) -> Column:
    """The first rule that fits a feature's name."""
    has = lambda p: name.rlike(p)
    rules = [
        (has("missing"), "missingness"),
        (name.isin("event_day_number", "overall_ctr"), "context"),
        (has("^i.*_log_scale$"), "numeric_log"),
        (has("^i[0-9]+$"), "numeric_raw"),
        (has("_bucket_code_enc_|bucket_lift|_bucket_ctr_lift$"), "bucket_signal"),
        (has("^c.*_ctr_lift$"), "categorical_lift"),
        (has("support|_log1p$"), "support_signal"),
        (has("_enc_"), "target_encoding"),
        (has("_x_"), "interaction"),
        (has("^numeric_"), "numeric_aggregate"),
        (has("^categorical_"), "categorical_aggregate"),
        (has("^total_|_ratio$"), "aggregate"),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("other")


#: Fixed texts.
DIRECTION = {"positive": "Higher values of this feature push predicted CTR upward.", "negative": "Higher values of this feature push predicted CTR downward.", "neutral": "This feature has a neutral coefficient in the latest fitted model."}
GROUP = {
    "bucket_signal": "The model is using a bucket-derived historical or encoded signal.",
    "categorical_lift": "This categorical lift feature reflects how a hashed value performed relative to baseline CTR.",
    "target_encoding": "This encoded categorical feature summarizes historical click behavior for a sparse value.",
    "numeric_log": "The model is reacting to the log-scaled magnitude of a numeric input.",
    "support_signal": "This support feature reflects how frequently the categorical value appeared historically.",
    "missingness": "Missing-value patterns are influencing expected click likelihood.",
    "context": "This is a broad context feature rather than a specific sparse identity signal.",
}


def note(group: Column, direction: Column) -> Column:
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    return F.concat_ws(" ", F.try_element_at(table(DIRECTION), direction), F.try_element_at(table(GROUP), group))


def importance(coefficients: DataFrame, group: list[str]) -> DataFrame:
    """coefficients (group, feature_name, importance_value). Adds size, share of the total size, direction, feature group, note and rank."""
    size = F.abs("importance_value")
    total = F.sum(size).over(Window.partitionBy(*group))
    direction = F.when(F.col("importance_value") > 0, "positive").when(F.col("importance_value") < 0, "negative").otherwise("neutral")
    c = coefficients.withColumn("abs_importance_value", size).withColumn("relative_importance_pct", F.round(F.coalesce(F.try_divide(size, total), F.lit(0.0)), 6))
    c = c.withColumn("importance_direction", direction).withColumn("feature_group", feature_group(F.col("feature_name")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("abs_importance_value"), F.asc("feature_name")))
    return c.withColumn("interpretation_note", note(F.col("feature_group"), F.col("importance_direction"))).withColumn("importance_rank", rank)


def top_features(frame: DataFrame, n: int) -> DataFrame:
    return frame.where(F.col("importance_rank") <= n)
