"""Exact ranking and calibration metrics, deciles and score summaries, for any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.ranks import ranked, running_sums

#: Scores are clipped this far from 0 and 1 before logarithms.
EPS = 2.220446049250313e-16


def _by_score(scored: DataFrame, group: list[str]) -> DataFrame:
    """For each distinct score: positives and negatives there, below it, and in all."""
    counts = scored.groupBy(*group, (-F.col("score")).alias("s")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return running_sums(counts, group, "s", ["pos", "neg"])  # descending score


def _auc() -> Column:
    below = F.col("neg_total") - F.col("neg_before") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return F.round(F.try_divide(won, F.max("pos_total").cast("double") * F.max("neg_total")), 6).alias("roc_auc")


def _precision() -> Column:
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg"))
    return F.round(F.coalesce(F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_total").cast("double")), F.lit(0.0)), 6).alias("pr_auc")


def roc_auc(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group, roc_auc): the share of pairs of a positive and a negative in which the positive scores higher, ties counting half. Scores are
    grouped first, so only distinct scores are put in order. Null without both classes."""
    return _by_score(scored, group).groupBy(*group).agg(_auc())


def average_precision(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group, pr_auc): the mean over positives of the precision at their score, in steps; 0 without positives."""
    return _by_score(scored, group).groupBy(*group).agg(_precision())


def log_loss_brier(scored: DataFrame, group: list[str]) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(EPS)), F.lit(1 - EPS))
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return scored.groupBy(*group).agg(F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))), 6).alias("brier_score"))


def at_top(scored: DataFrame, group: list[str], share: float = 0.10, tie: str = "raw_event_id") -> DataFrame:
    """(group, precision_at_10pct, lift_at_10pct): of the best-scored share of rows, at least one, the rate of positives, and that over the rate
    of all rows; ties go to the smaller id; no positives give a lift of 0."""
    r = ranked(scored.select(*group, "score", "label", tie), group, [F.desc("score"), F.asc(tie)])
    inside = F.col("rank0") < F.greatest(F.lit(1), F.ceil(F.col("total") * share - 1e-9))
    sums = r.groupBy(*group).agg(F.avg(F.when(inside, F.col("label"))).alias("precision"), F.avg("label").alias("base"))
    return sums.select(*group, F.round("precision", 6).alias("precision_at_10pct"), F.round(F.coalesce(F.try_divide("precision", "base"), F.lit(0.0)), 6).alias("lift_at_10pct"))


def evaluate(scored: DataFrame, group: list[str], tie: str = "raw_event_id") -> DataFrame:
    """All six metrics of each group of (score, label). Distinct scores are put in order once for both areas."""
    out = _by_score(scored, group).groupBy(*group).agg(_auc(), _precision())
    for other in (log_loss_brier(scored, group), at_top(scored, group, 0.10, tie)):
        out = out.join(other, group) if group else out.crossJoin(F.broadcast(other))
    return out


def with_deciles(scores: DataFrame, group: list[str], score: str = "predicted_ctr", tie: str = "raw_event_id") -> DataFrame:
    """Adds score_decile (10 is best) and is_top_decile: 10 less ten times the share of rows ranked before. Ties go by id."""
    r = ranked(scores, group, [F.desc(score), F.asc(tie)])
    decile = (10 - F.least(F.lit(9), F.floor(F.col("rank0") * 10 / F.col("total")))).cast("int")
    return r.withColumn("score_decile", decile).withColumn("is_top_decile", F.col("score_decile") == 10).drop("rank0", "total")


def score_summary(scores: DataFrame, group: list[str]) -> DataFrame:
    """Rows, mean score and rate, over all rows and over the top decile; 0 where there are none."""
    top = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("is_top_decile"), F.col(c))), F.lit(0.0)), 6)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scores.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"), mean("predicted_ctr").alias("avg_predicted_ctr"), mean("actual_click").alias("actual_ctr"), F.count_if("is_top_decile").alias("top_decile_row_count"), top("actual_click").alias("top_decile_actual_ctr"), top("predicted_ctr").alias("top_decile_avg_predicted_ctr"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Tuning results, best first."""
    return results.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.desc("lift_at_10pct"), F.asc("log_loss"))


def halves(scored: DataFrame, order: str = "raw_event_id") -> DataFrame:
    """Adds calibration_half: `fit` for the first half of the rows in the order, `evaluate` for the rest."""
    r = ranked(scored, [], [F.asc(order)])
    return r.withColumn("calibration_half", F.when(F.col("rank0") < F.floor(F.col("total") / 2), "fit").otherwise("evaluate")).drop("rank0", "total")
