"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import drop, saved


def _least(links: DataFrame) -> DataFrame:
    """Of each u the least v. Written, so that the join that follows has a shuffle on both sides and a hub can be split."""
    return saved(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long): undirected. Returns (node, root): each linked node with the least node it can reach.

    Loops (u = v) and nulls link nothing; repeated links count once; no links give an empty table. Each round hangs every node
    on its least neighbour (large star, then small star) until nothing changes; that takes about log(n) rounds. Links stay in
    tables throughout: the driver sees a count and a checksum a round.
    """
    edges = links.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = saved(edges.distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = saved(large.distinct(), "large")
        drop(least)
        drop(edges)
        least = _least(large)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.distinct(), "small")
        drop(least)
        drop(large)
        mark, before = _mark(edges), mark
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
