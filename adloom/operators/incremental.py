"""Logistic models trained chunk by chunk, for any number of settings at once, from a state that can be kept and gone on from.

Rows are cut into chunks in the order in which they are read, and a chunk into shards. Each step takes a chunk: every shard goes over its
rows from the weights of the step before, in small batches, for all settings together (the weights are a matrix), and the shards' weights are
averaged by their rows. So a step is one job whatever the number of settings, what leaves a task is a matrix of weights, and the state
after a step depends on the steps before it alone: training that stops after some steps and goes on later ends where training at once ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators.features import class_weights
from adloom.operators.ranks import numbered
from adloom.sources.work import shared_dir

#: Rows of a chunk, shards of it at least, numbers of a shard at most, about (a task holds them, 8 bytes each), and rows of a small batch.
CHUNK, SHARDS, SHARD_NUMBERS, BATCH = 100_000, 8, 8_000_000, 128


@dataclass
class Setting:
    """alpha: the penalty's weight, l1: the share of it that is on absolute weights. rate: of the first step."""

    name: str
    alpha: float = 1e-5
    l1: float = 0.0
    epochs: int = 3
    rate: float = 0.3


SETTINGS = [Setting("base", 1e-5, epochs=2), Setting("longer", 5e-6), Setting("elastic", 8e-6, 0.08), Setting("more_penalty", 1.5e-5), Setting("slow", 1e-5, epochs=4, rate=0.05)]


@dataclass
class State:
    """What training knows after `done` steps. weights: of each setting those of the columns and the intercept."""

    settings: list[Setting]
    columns: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[list[float]]
    done: int = 0
    history: list[int] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> State:
        found = json.loads(text)
        return State(**found | {"settings": [Setting(**s) for s in found["settings"]]})

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.text(),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> State:
        return State.of(spark.read.text(path).first()[0])


def begin(train: DataFrame, columns: list[str], settings: list[Setting]) -> State:
    """The state before the first step; means and deviations are those of all rows, 1 for a constant."""
    sums = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    mean, scale = ([float(sums[f"{k}{i}"] or default) for i in range(len(columns))] for k, default in (("m", 0.0), ("s", 1.0)))
    return State(settings, columns, mean, scale, [[0.0] * (len(columns) + 1) for _ in settings])


def chunked(train: DataFrame, state: State, rows: int = CHUNK) -> str:
    """Writes the scaled rows, with balanced weights, by chunks and shards; returns the path. Label and columns of train are read once. A shard is one file
    in the order of its rows, and its size is under that of a row group, so a step reads each by one task and shuffles nothing."""
    spark = train.sparkSession
    x = F.array(*((F.col(c).cast("double") - m) / s for c, m, s in zip(state.columns, state.mean, state.scale)))
    own = train.join(F.broadcast(class_weights(train)), "label").select(x.alias("x"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"))
    path = f"{shared_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    shards = max(SHARDS, -(-rows * (len(state.columns) + 1) // SHARD_NUMBERS))
    out = numbered(own, "row").withColumn("chunk", F.floor(F.col("row") / rows)).withColumn("shard", (F.col("row") % shards).cast("int"))
    out.repartition("chunk", "shard").sortWithinPartitions("chunk", "shard", "row").write.partitionBy("chunk", "shard").parquet(path)
    return path


def _local(weights: np.ndarray, settings: list[Setting], done: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Weights (columns and intercept, settings) after the rows."""
    w = weights.copy()
    alpha, l1, rate = (np.array([getattr(s, n) for s in settings]) for n in ("alpha", "l1", "rate"))
    x = np.hstack([x, np.ones((len(x), 1))])
    for i in range(0, len(x), BATCH):
        xb, yb, own = x[i : i + BATCH], y[i : i + BATCH, None], weight[i : i + BATCH, None]
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -40, 40)))
        eta = np.where(live, rate / np.sqrt(1 + done + i / max(1, len(x))), 0.0)
        grad = xb.T @ ((p - yb) * own) / max(own.sum(), 1e-300)
        w[:-1] *= 1 - eta * alpha * (1 - l1)
        w -= eta * grad
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - eta * alpha * l1, 0)
    return w


def step(state: State, spark: SparkSession, path: str, chunk: int, epoch: int) -> State:
    """The state after one chunk. Settings whose epochs are over keep their weights."""
    weights, live = np.array(state.weights).T, np.array([epoch < s.epochs for s in state.settings])
    settings, done = state.settings, state.done
    schema = "shard int, n long, w array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            shard, x = b.column(0).to_numpy(), b.column(1)
            matrix = x.flatten().to_numpy().reshape(len(x), -1)
            for s in np.unique(shard).tolist():
                own = shard == s
                held.setdefault(s, []).append((matrix[own], b.column(2).to_numpy()[own], b.column(3).to_numpy()[own]))
        for s, parts in held.items():
            x, y, weight = (np.concatenate(p) for p in zip(*parts))
            w = _local(weights, settings, done, x, y, weight, live)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": pa.array([len(x)], pa.int64()), "w": pa.array([w.ravel()], pa.list_(pa.float64()))})

    rows = spark.read.parquet(path).where(F.col("chunk") == chunk).select(F.col("shard").cast("int").alias("shard"), "x", "y", "weight")
    out = rows.mapInArrow(run, schema).orderBy("shard").collect()  # a row a shard
    total = sum(r["n"] for r in out)
    if total:
        weights = sum(np.array(r["w"]).reshape(weights.shape) * (r["n"] / total) for r in out)
    return State(state.settings, state.columns, state.mean, state.scale, weights.T.tolist(), state.done + 1, [*state.history, total])


def fit(state: State, spark: SparkSession, path: str, steps: int | None = None) -> State:
    """Goes on from the state over the chunks at path, epoch after epoch, to the last epoch of any setting or for so many steps."""
    chunks = sorted(r["chunk"] for r in spark.read.parquet(path).select("chunk").distinct().collect())
    last = len(chunks) * max(s.epochs for s in state.settings)
    for at in range(state.done, last if steps is None else min(last, state.done + steps)):
        state = step(state, spark, path, chunks[at % len(chunks)], at // len(chunks))
    return state


def scored(frame: DataFrame, state: State, keep: list[str]) -> DataFrame:
    """(keep, config, score): each row's probability of a click by each setting. Expressions only; no Python worker."""
    def probability(weights: list[float]) -> Column:
        z = F.lit(weights[-1])
        for c, m, s, w in zip(state.columns, state.mean, state.scale, weights):
            if w:
                z = z + (F.col(c).cast("double") - m) * (w / s)
        return 1 / (1 + F.exp(-z))

    each = F.array(*(F.struct(F.lit(s.name).alias("config"), probability(w).alias("score")) for s, w in zip(state.settings, state.weights)))
    return frame.select(*keep, F.inline(each))


def train(frame: DataFrame, columns: list[str], settings: list[Setting], rows: int = CHUNK) -> State:
    """Scaling, then all steps."""
    state = begin(frame, columns, settings)
    return fit(state, frame.sparkSession, chunked(frame, state, rows))
