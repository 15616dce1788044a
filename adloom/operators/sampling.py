"""Exact-size stratified samples that are the same on every run, and samples nested in each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.ranks import ranked
from adloom.sources.work import saved


def stratum_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"))


def targets(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(sample_name, label, target): of each sample the rows of either label, in the proportion of the whole (halves to even)."""
    n = rows.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("sample_name"), F.lit(v).cast("long").alias("size")) for k, v in sizes.items())))
    n = n.withColumn("s", wanted).select("n0", "n1", "s.*")
    one = F.least(F.bround(F.col("size") * F.col("n1") / (F.col("n0") + F.col("n1"))).cast("long"), F.col("n1"), F.col("size"))
    zero = F.least(F.col("size") - one, F.col("n0"))
    n = n.withColumn("zero", zero)
    return n.select("sample_name", F.inline(F.array(F.struct(F.lit(0).alias("label"), F.col("zero").alias("target")), F.struct(F.lit(1).alias("label"), (F.col("size") - F.col("zero")).alias("target")))))


def key(seed: int, row_id: Column) -> Column:
    """A row's place in the random order: a digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")).cast("binary"))


def nested_samples(rows: DataFrame, sizes: dict[str, int], row_id: str = "event_id", seed: int = 7) -> DataFrame:
    """rows with sample_name: a row for each sample that it is in. One order serves all sizes, so a smaller sample is within a larger.

    Only rows whose digest is under a bound are put in order: the bound lets through somewhat more rows of each label than the largest
    sample takes, and is raised until it lets through enough. Wide rows are joined afterwards.
    """
    wanted = saved(targets(rows, sizes), "targets")
    most = {r["label"]: r["most"] for r in wanted.groupBy("label").agg(F.max("target").alias("most")).collect()}
    have = {r["label"]: r["row_count"] for r in stratum_sizes(rows).collect()}
    own = rows.select(row_id, "label").withColumn("_key", key(seed, F.col(row_id)))
    first = F.conv(F.substring("_key", 1, 12), 16, 10).cast("long")  # 48 bits
    bound = {x: (n + 6 * n**0.5 + 20) / max(have.get(x, 1), 1) for x, n in most.items()}
    while True:
        under = F.coalesce(*(F.when(F.col("label") == x, first <= int(min(1.0, b) * (1 << 48))) for x, b in bound.items()))
        near = saved(own.where(under), "near")
        found = {r["label"]: r["row_count"] for r in stratum_sizes(near).collect()}
        short = [x for x, n in most.items() if found.get(x, 0) < min(n, have.get(x, 0))]
        if not short:
            break
        bound |= {x: 2 * bound[x] for x in short}
    order = ranked(near, ["label"], [F.col("_key"), F.col(row_id)]).select(row_id, "label", "rank0")
    hit = order.join(F.broadcast(wanted), "label").where("rank0 < target").select(row_id, "sample_name")
    return rows.join(hit, row_id)


def write_samples(samples: DataFrame, path: str, row_id: str = "event_id") -> None:
    """One folder a sample, rows in their original order within files."""
    samples.repartitionByRange("sample_name", row_id).sortWithinPartitions("sample_name", row_id).write.mode("overwrite").partitionBy("sample_name").option("header", True).csv(path)


def summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_name").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("label") == 1).alias("clicks"), F.count_if(F.col("label") == 0).alias("non_clicks"), F.round(F.avg("label"), 6).alias("ctr"))
