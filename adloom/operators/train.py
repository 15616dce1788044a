"""Click models, calibration and scoring with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.evaluate import halves
from adloom.operators.features import class_weights, positive_weight

#: Numbers that a task holds of the rows that it trains on, at most (4 or 8 bytes each).
TASK_NUMBERS = 32_000_000


def dealt(frame: DataFrame, width: int) -> DataFrame:
    """The rows, whose vectors have `width` places, in so many tasks that none holds more than TASK_NUMBERS numbers, about. Trees keep whole vectors of all rows
    of a task, and files, where values are coded, are small beside them, so their sizes don't bound that."""
    tasks = max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() * max(1, width) // TASK_NUMBERS))
    return frame.repartition(tasks, F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns)))


def width_of(prepared: PipelineModel, frame: DataFrame) -> int:
    """Places of the vectors that the encoder makes."""
    return prepared.transform(frame.limit(1)).select(F.size(vector_to_array("features")).alias("n")).agg(F.max("n")).first()[0] or 1


def fit_encoder(frame: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Standardised numbers (by the population's deviation, 1 for a constant) and one-hot categories in one vector. A missing number is 0, a missing
    category is `unknown`; a category that the frame doesn't have sets no place."""
    filled = {c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numeric}
    stats = frame.agg(*(F.avg(x).alias(f"a_{c}") for c, x in filled.items()), *(F.stddev_pop(x).alias(f"d_{c}") for c, x in filled.items())).first()
    number = lambda c: f"(coalesce(nanvl(CAST(`{c}` AS DOUBLE), 0D), 0D) - ({float(stats[f'a_{c}'] or 0)!r}D)) / {float(stats[f'd_{c}'] or 1)!r}D AS `{c}_scaled`"
    made = [*map(number, numeric), *(f"coalesce(CAST(`{c}` AS STRING), 'unknown') AS `{c}_filled`" for c in categorical)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")]
    inputs = [f"{c}_scaled" for c in numeric]
    if categorical:
        index = StringIndexer(inputCols=[f"{c}_filled" for c in categorical], outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep")
        hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_hot" for c in categorical])
        stages += [index, hot]
        inputs += hot.getOutputCols()
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(frame)


def assembler(columns: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")])


def with_class_weight(frame: DataFrame) -> DataFrame:
    """Adds weight, balanced by label."""
    return frame.join(F.broadcast(class_weights(frame)), "label")


def with_positive_weight(frame: DataFrame) -> DataFrame:
    """Adds weight: negatives over positives for positives, 1 for others."""
    return frame.crossJoin(F.broadcast(positive_weight(frame))).withColumn("weight", F.when(F.col("label") == 1, F.col("scale_pos_weight")).otherwise(1.0)).drop("scale_pos_weight")


def logistic(reg: float = 0.0, elastic: float = 0.0, iterations: int = 50) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, elasticNetParam=elastic, maxIter=iterations, standardization=False)


def boosted(rounds: int = 20, depth: int = 4, rate: float = 0.1, subsample: float = 0.9, validation: str | None = None, seed: int = 7) -> GBTClassifier:
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)
    return model.setValidationIndicatorCol(validation) if validation else model


def fit_logistic(frame: DataFrame, numeric: list[str], categorical: list[str], c: float = 1.0) -> PipelineModel:
    """A balanced logistic model over encoded columns, fitted by all executors. c: the inverse of the penalty on half the squared weights, beside
    the sum of all rows' losses."""
    weighted = with_class_weight(frame)
    prepared = fit_encoder(weighted, numeric, categorical)
    total = weighted.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0]
    return PipelineModel(stages=[*prepared.stages, logistic(1 / (c * total)).fit(prepared.transform(dealt(weighted, len(numeric) + len(categorical))))])


def fit_engineered(train: DataFrame, columns: list[str], model: str = "logistic", validation: DataFrame | None = None, **options) -> PipelineModel:
    """A model over engineered columns; boosted trees stop on the validation rows where these are given."""
    if model == "logistic":
        frame, estimator = with_class_weight(train), logistic(**options)
    else:
        frame = with_positive_weight(train).withColumn("held", F.lit(False))
        if validation is not None:
            frame = frame.unionByName(validation.withColumn("weight", F.lit(1.0)).withColumn("held", F.lit(True)))
        estimator = boosted(validation="held" if validation is not None else None, **options)
    prepared = assembler(columns).fit(frame)
    return PipelineModel(stages=[*prepared.stages, estimator.fit(prepared.transform(dealt(frame, len(columns))))])


def score(frame: DataFrame, model: Transformer, keep: list[str], name: str = "score", calibrator: Calibrator | None = None) -> DataFrame:
    """The columns `keep` and the model's probability of a click, put through the calibrator where the model comes with one."""
    raw = model.transform(frame).select(*keep, vector_to_array("probability")[1].alias("score"))
    if calibrator is None:
        return raw.withColumnRenamed("score", name)
    return calibrator.apply(raw, "_calibrated").drop("score").withColumnRenamed("_calibrated", name)


@dataclass
class Calibrator:
    """A map from scores to probabilities."""

    model: Transformer
    kind: str

    def apply(self, scored: DataFrame, name: str = "calibrated") -> DataFrame:
        if self.kind == "sigmoid":
            slope, intercept = float(self.model.coefficients[0]), float(self.model.intercept)
            return scored.withColumn(name, 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(intercept)))))
        out = self.model.transform(scored).withColumn(name, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
        return out.drop("prediction")


def calibrator(scored: DataFrame, kind: str = "sigmoid", c: float | None = None) -> Calibrator:
    """Fitted on (score, label): a logistic curve over the score, or the best monotone step function. c: of the curve the inverse of a penalty on half the
    squared slope, beside the sum of all rows' losses; none without it."""
    if kind == "sigmoid":
        frame = VectorAssembler(inputCols=["score"], outputCol="features").transform(scored)
        penalty = 1 / (c * max(1, frame.count())) if c else 0.0
        return Calibrator(LogisticRegression(featuresCol="features", labelCol="label", regParam=penalty, standardization=False, tol=1e-9).fit(frame), kind)
    if kind == "isotonic":
        return Calibrator(IsotonicRegression(featuresCol="score", labelCol="label").fit(scored.withColumn("label", F.col("label").cast("double"))), kind)
    raise ValueError(f"no such calibration: {kind}")


def calibrate(validation: DataFrame, kind: str = "sigmoid", order: str = "raw_event_id") -> tuple[Calibrator, DataFrame]:
    """A calibrator fitted on the first half of the validation rows (a sigmoid with c = 1), and the other half, on which to evaluate it."""
    split = halves(validation, order)
    return calibrator(split.where("calibration_half = 'fit'"), kind, 1.0), split.where("calibration_half = 'evaluate'").drop("calibration_half")


def find_model(registry: DataFrame, runs: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """One row: the ready model of that name, of the version or else the active one, with its newest successful run."""
    m = registry.where((F.col("model_name") == name) & (F.col("model_status") == "READY"))
    m = m.where(F.col("model_version") == version) if version else m.where("is_active_canonical")
    j = m.join(runs.where("run_status = 'SUCCESS'").select("model_id", "training_run_id", "completed_at"), "model_id")
    return j.orderBy(F.desc_nulls_last("completed_at"), F.desc("training_run_id")).limit(1)


def coefficients(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """(feature_name, importance_value) of the last stage: coefficients, or importances of trees."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values.toArray())], "feature_name string, importance_value double")
