"""Calibration of many models' scores at once: no plan and no job is of one model alone.

Scores are counted first (of each group its distinct scores, with rows and clicks), so all that follows works on these. Groups are
named by columns, such as model_id; the number of groups and of rows in one is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.operators.ranks import ranked, running_sums
from adloom.sources.work import saved

#: Newton steps at most, the step that ends them, and how far one step may go.
STEPS, NEAR, FAR = 50, 1e-10, 5.0


def halves(scored: DataFrame, group: list[str], order: str = "raw_event_id") -> DataFrame:
    """Adds calibration_half: `fit` for the first half of each group's rows in the order, `evaluate` for the rest."""
    r = ranked(scored, group, [F.asc(order)])
    return r.withColumn("calibration_half", F.when(F.col("rank0") < F.floor(F.col("total") / 2), "fit").otherwise("evaluate")).drop("rank0", "total")


def _counted(scored: DataFrame, group: list[str]) -> DataFrame:
    return scored.groupBy(*group, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("double").alias("clicks"))


def sigmoid(scored: DataFrame, group: list[str], c: float = 1.0) -> DataFrame:
    """scored (group, score, label). Returns (group, slope, intercept): of each group the curve 1 / (1 + exp(-(slope * score + intercept))) of least loss, with
    a penalty of slope^2 / 2c beside the sum over rows. Newton's steps are taken for all groups together, a job a step; a group of one
    class has no optimum and gets the curve after the last step."""
    cells = saved(_counted(scored, group), "cells")
    now = saved(cells.select(*group).distinct().withColumn("slope", F.lit(0.0)).withColumn("intercept", F.lit(0.0)), "curves")
    p = 1 / (1 + F.exp(-(F.col("slope") * F.col("score") + F.col("intercept"))))
    for _ in range(STEPS):
        at = cells.join(now, group).withColumn("p", p).withColumn("wrong", F.col("n") * F.col("p") - F.col("clicks")).withColumn("w", F.col("n") * F.col("p") * (1 - F.col("p")))
        sums = at.groupBy(*group, "slope", "intercept").agg(F.sum(F.col("wrong") * F.col("score")).alias("ga"), F.sum("wrong").alias("gb"), F.sum(F.col("w") * F.col("score") * F.col("score")).alias("haa"), F.sum(F.col("w") * F.col("score")).alias("hab"), F.sum("w").alias("hbb"))
        ga, haa = F.col("ga") + F.col("slope") / c, F.col("haa") + 1 / c
        det = F.greatest(haa * F.col("hbb") - F.col("hab") * F.col("hab"), F.lit(1e-300))
        step = lambda x: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), x))
        a, b = step((F.col("hbb") * ga - F.col("hab") * F.col("gb")) / det), step((haa * F.col("gb") - F.col("hab") * ga) / det)
        now = saved(sums.select(*group, (F.col("slope") - a).alias("slope"), (F.col("intercept") - b).alias("intercept"), F.greatest(F.abs(a), F.abs(b)).alias("moved")), "curves")
        far = now.agg(F.max("moved")).first()[0]
        now = now.drop("moved")
        if far is None or far < NEAR:
            break
    return now


def apply_sigmoid(scored: DataFrame, curves: DataFrame, group: list[str], name: str = "calibrated") -> DataFrame:
    """Adds the calibrated score; null for a group without a curve."""
    out = scored.join(curves, group, "left")
    return out.withColumn(name, 1 / (1 + F.exp(-(F.col("slope") * F.col("score") + F.col("intercept"))))).drop("slope", "intercept")


def _pool(lo: list[float], hi: list[float], n: list[int], clicks: list[float]) -> list[tuple]:
    """Neighbours whose rates don't rise are pooled, until all rise."""
    out: list[list] = []
    for block in zip(lo, hi, n, clicks):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, m, s = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = top, out[-1][2] + m, out[-1][3] + s
    return out


def isotonic(scored: DataFrame, group: list[str]) -> DataFrame:
    """scored (group, score, label). Returns (group, lo, hi, n, clicks): the blocks of the best rising step function of each group, from score lo to hi,
    with rows and clicks; a block's rate is clicks / n.

    Pooling within ranges of the scores and then among the blocks that are left gives what pooling all at once does. Ranges are cut so that tasks are
    of a size; then a group's blocks, a step function that rises within each range, are pooled by one task.
    """
    cells = _counted(scored, group).select(*group, F.col("score").alias("lo"), F.col("score").alias("hi"), "n", "clicks")
    schema = T.StructType([*(cells.schema[g] for g in group), *(T.StructField(c, k) for c, k in (("lo", T.DoubleType()), ("hi", T.DoubleType()), ("n", T.LongType()), ("clicks", T.DoubleType())))])
    arrow, width = to_arrow_schema(schema), len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pooled(t: pa.Table) -> pa.RecordBatch:
            names = [[x] * 0 for x in range(width)]
            keys = list(zip(*(t.column(i).to_pylist() for i in range(width)))) if width else [()] * t.num_rows
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            columns = [t.column(width + i).to_pylist() for i in range(4)]
            blocks: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                own = _pool(*(c[a:b] for c in columns))
                blocks += own
                for name, key in zip(names, keys[a]):
                    name += [key] * len(own)
            values = list(zip(*blocks))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*names, *values], arrow)], schema=arrow)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
        whole = pa.concat_tables(held) if held else None
        if whole is not None and whole.num_rows:
            yield pooled(whole)

    ranges = cells.repartitionByRange(*group, "lo").sortWithinPartitions(*group, "lo").mapInArrow(run, schema)
    ranges = saved(ranges, "ranges")
    merged = ranges.repartition(*group) if group else ranges.repartition(1)
    return saved(merged.sortWithinPartitions(*group, "lo").mapInArrow(run, schema), "blocks")


def apply_isotonic(scored: DataFrame, blocks: DataFrame, group: list[str], name: str = "calibrated") -> DataFrame:
    """Adds the calibrated score: the rate of the block that the score is in, between two blocks on the line between them, outside all the nearest's;
    null for a group without blocks. A block is found by how many begin at or under a score, counted over the distinct scores in order."""
    zero = F.lit(0).cast("long")
    marks = scored.groupBy(*group, F.col("score").alias("s")).agg(zero.alias("begins")).unionByName(blocks.select(*group, F.col("lo").alias("s"), F.lit(1).cast("long").alias("begins")))
    places = running_sums(marks.groupBy(*group, "s").agg(F.sum("begins").alias("begins")), group, "s", ["begins"])
    places = saved(places.select(*group, "s", (F.col("begins_before") + F.col("begins")).alias("block"), "begins"), "places")
    numbered = blocks.join(places.where("begins > 0").select(*group, F.col("s").alias("lo"), "block"), [*group, "lo"]).select(*group, "block", "lo", "hi", (F.col("clicks") / F.col("n")).alias("rate"))
    numbered = saved(numbered, "numbered")
    own = places.join(numbered, [*group, "block"], "left").select(*group, "s", "block", "hi", "rate")
    after = numbered.select(*group, (F.col("block") - 1).alias("block"), F.col("lo").alias("next_lo"), F.col("rate").alias("next_rate"))
    own = own.join(after, [*group, "block"], "left")
    between = F.col("rate") + (F.col("next_rate") - F.col("rate")) * (F.col("s") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    value = F.when(F.col("rate").isNull(), F.col("next_rate")).when((F.col("s") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("rate")).otherwise(between)
    return scored.join(own.select(*group, F.col("s").alias("score"), value.alias(name)), [*group, "score"])
