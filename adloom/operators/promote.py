"""Which candidate model becomes the active one, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.monitor import active_canonical
from adloom.operators.tables import latest

METRICS = ["validation_roc_auc", "validation_pr_auc", "validation_lift_at_10pct"]


def _or_zero(side: str, m: str) -> Column:
    return F.coalesce(F.col(f"{side}_{m}"), F.lit(0.0))


def decide(candidates: DataFrame, active: DataFrame, base: DataFrame, base_version: str, roc: float = 0.005, pr: float = 0.005, lift: float = 0.05, least_rows: int = 500_000) -> DataFrame:
    """candidates, active, base (model_name, model_version, training_run_id, rows_trained, metrics): all candidates of all names at once.
    Returns candidates with promoted and decision_reason; the first rule that applies decides."""
    side = lambda df, name: df.select("model_name", F.lit(True).alias(f"has_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in ("model_version", "training_run_id", *METRICS)))
    j = candidates.join(side(active, "active"), "model_name", "left").join(side(base, "base"), "model_name", "left")
    c = F.col
    is_base = c("model_version") == base_version
    beaten = ~is_base & F.coalesce("has_base", F.lit(False)) & ~c("base_training_run_id").eqNullSafe(c("training_run_id"))
    for m in METRICS:
        beaten &= _or_zero("base", m) >= c(m)
    same = is_base & (c("active_model_version") != base_version)
    for m in METRICS:
        same &= F.abs(c(m) - _or_zero("active", m)) < 1e-9
    ok = {m: c(m) >= _or_zero("active", m) + by for m, by in zip(METRICS, (roc, pr, lift))}
    names = dict(zip(METRICS, ("ROC-AUC", "PR-AUC", "lift")))
    reasons = F.concat(F.concat_ws("; ", *(F.when(~ok[m], f"{names[m]} threshold not met") for m in METRICS)), F.lit("."))
    complete = c(METRICS[0]).isNotNull() & c(METRICS[1]).isNotNull() & c(METRICS[2]).isNotNull()
    rules = [
        (c("rows_trained") < least_rows, False, "Candidate run is not large-scale enough for canonical promotion."),
        (~complete, False, "Candidate run does not have complete validation and ranking metrics."),
        (beaten, False, "Scheduled candidate does not beat the canonical base version on ROC-AUC, PR-AUC, and lift."),
        (c("has_active").isNull(), True, "No active canonical model exists yet; promoting the first large-scale qualified model."),
        (c("active_training_run_id") == c("training_run_id"), False, "Candidate is already the active canonical training run."),
        (same, True, "Candidate matches the scheduled clone on metrics and reclaims the canonical base version slot."),
        (ok[METRICS[0]] & ok[METRICS[1]] & ok[METRICS[2]], True, "Candidate exceeded the active canonical model on ROC-AUC, PR-AUC, and lift thresholds."),
    ]
    promoted, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, yes, why in rules[1:]:
        promoted, reason = promoted.when(when, yes), reason.when(when, why)
    return j.select(*candidates.columns, promoted.otherwise(False).alias("promoted"), reason.otherwise(reasons).alias("decision_reason"))


def apply(registry: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """The registry after promotions: of a name with a promoted candidate, the one of the newest run is active and no other."""
    won = latest(decisions.where("promoted"), ["model_name"], [F.desc("training_run_id")]).select("model_name", F.col("model_id").alias("_won"), "decision_reason")
    j = registry.join(won, "model_name", "left")
    now = F.col("model_id") == F.col("_won")
    return j.select("model_id", "model_name", "model_version", F.when(F.col("_won").isNull(), F.col("is_active_canonical")).otherwise(now).alias("is_active_canonical"), F.when(now, at).otherwise(F.col("canonical_promoted_at")).alias("canonical_promoted_at"), F.when(now, F.col("decision_reason")).otherwise(F.col("canonical_promotion_note")).alias("canonical_promotion_note"))


def normalise(registry: DataFrame, runs: DataFrame, compared: DataFrame, base_version: str) -> DataFrame:
    """The registry with one active model a name: of several, the one stays that has the best successful run, by ROC-AUC, PR-AUC and lift (0 where
    unknown), then the base version, then the one promoted last, then the newest run, then the larger id."""
    own = compared.select("model_name", "model_version", "training_run_id", *METRICS).distinct()
    tried = registry.where("is_active_canonical").join(runs.where("run_status = 'SUCCESS'").select("model_id", "training_run_id"), "model_id", "left").join(own, ["model_name", "model_version", "training_run_id"], "left")
    order = [*(F.desc(F.coalesce(m, F.lit(0.0))) for m in METRICS), F.desc(F.col("model_version") == base_version), F.desc_nulls_last("canonical_promoted_at"), F.desc_nulls_last("training_run_id"), F.desc("model_id")]
    best = latest(tried, ["model_name"], order).select(F.col("model_id").alias("_best"), F.lit(True).alias("_keep"))
    return registry.join(best, F.col("model_id") == F.col("_best"), "left").withColumn("is_active_canonical", F.coalesce("_keep", F.lit(False))).select(*registry.columns)


def review(registry: DataFrame, runs: DataFrame, compared: DataFrame, base_version: str, **thresholds: float) -> tuple[DataFrame, DataFrame]:
    """The registry normalised, and the decision on each run of each of its models against the model that is active then."""
    columns = ["model_name", "model_version", "training_run_id", *METRICS]
    registry = normalise(registry, runs, compared, base_version)
    active = active_canonical(registry, runs, compared).select(*columns).distinct().where("training_run_id is not null")
    candidates = compared.select(*columns, "rows_trained").distinct().join(registry.select("model_name", "model_version", "model_id"), ["model_name", "model_version"])
    base = latest(candidates.where(F.col("model_version") == base_version), ["model_name"], [F.desc("training_run_id")]).select(*columns)
    return registry, decide(candidates, active, base, base_version, **thresholds)
