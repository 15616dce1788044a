"""Ranks and running sums over any number of rows, without a window that holds all of them in one task.

Rows are dealt out by ranges of the order and sorted within tasks; each task's rows are counted, the counts (one row a task and
group) are summed up in order, and a row's rank is its place in its task plus what comes before the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.sources.work import saved


#: Rows of a range at least, where a table's size is known.
RANGE_ROWS = 50_000
#: Places at which tiles begin that are sent to all tasks, at most: a narrow row each.
BROADCAST_ROWS = 100_000


def ranges(table: DataFrame) -> int:
    """Into how many ranges the rows of a written table are dealt out."""
    return min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-table.count() // RANGE_ROWS)))


def _tasks(df: DataFrame, group: list[str], order: list[Column], n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in order, written with _id (task and place), and for each task and group: rows, first place, rows before, rows in all."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = saved(dealt.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    heads = dealt.groupBy(*group, F.shiftright("_id", 33).alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(*group)
    so_far = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, heads.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0))).withColumn("_total", F.sum("_n").over(whole))


def ranked(df: DataFrame, group: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """Adds rank0 (from 0, in order within the group) and total (rows of the group). The order should be total. n: how many ranges."""
    dealt, heads = _tasks(df, group, order, n)
    dealt = dealt.withColumn("_task", F.shiftright("_id", 33))
    out = dealt.join(heads, [*group, "_task"])
    return out.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias("rank0"), F.col("_total").alias("total"))


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Adds `name`: start, start + 1 and so on, in the order in which the rows are read, without a gap, however the input is split into
    tasks. The rows are written once; the only ones that are put in order are those of a count for each task."""
    written = saved(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    heads = written.groupBy(F.shiftright("_id", 33).alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = written.withColumn("_task", F.shiftright("_id", 33)).join(F.broadcast(heads), "_task")  # a row a task
    return out.select((F.lit(start).cast("long") + F.col("_before") + F.col("_id") - F.col("_first")).alias(name), *df.columns)


def placed(df: DataFrame, group: list[str], order: list[Column], dense: list[str], tie: list[str] | None = None, sums: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """Adds what windows over a group of any size would: rank0 (from 0), total, dense (from 1, by the columns `dense`, on which the order begins),
    tie_end (rows up to the last one with the same values in `tie`, likewise the first of the order) and for each c in sums c_so_far.

    Rows are dealt out by ranges of the order. Within a task windows are over its rows of a group; what spans tasks is put right from a
    row for each task and group: how many rows, sums and distinct values come before, and whether its first value is the last of
    the task before. Where a run of equal values ends is known to its tasks from their first and last values.
    """
    dealt, heads = _tasks(df, group, order, n)
    dealt = dealt.withColumn("_task", F.shiftright("_id", 33))
    own = Window.partitionBy(*group, "_task").orderBy("_id")
    value = F.struct(*dense)
    new = F.when(F.lag(value).over(own).isNull() | ~F.lag(value).over(own).eqNullSafe(value), 1).otherwise(0)
    local = dealt.select("*", new.alias("_new"))
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.select("*", F.sum("_new").over(so_far).alias("_dense"), *(F.sum(c).over(so_far).alias(f"_{c}") for c in sums))
    more = local.groupBy(*group, "_task").agg(F.max("_dense").alias("_kinds"), F.min_by(value, "_id").alias("_head"), F.max_by(value, "_id").alias("_tail"), *(F.sum(c).alias(f"_{c}_n") for c in sums))
    tasks = Window.partitionBy(*group).orderBy("_task")
    earlier = tasks.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.join(more, [*group, "_task"])
    heads = heads.withColumn("_same", F.when(F.lag("_tail").over(tasks).eqNullSafe(F.col("_head")) & F.lag("_task").over(tasks).isNotNull(), 1).otherwise(0))
    heads = heads.withColumn("_kinds_before", F.coalesce(F.sum(F.col("_kinds") - F.col("_same")).over(earlier), F.lit(0)) - F.col("_same"))
    for c in sums:
        heads = heads.withColumn(f"_{c}_before", F.coalesce(F.sum(f"_{c}_n").over(earlier), F.lit(0)))
    heads = saved(heads.drop("_head", "_tail"), "heads")
    joined = local.join(heads, [*group, "_task"])
    place = F.col("_before") + F.col("_id") - F.col("_first")
    columns = [place.alias("rank0"), F.col("_total").alias("total"), (F.col("_dense") + F.col("_kinds_before")).alias("dense"), *((F.col(f"_{c}") + F.col(f"_{c}_before")).alias(f"{c}_so_far") for c in sums)]
    if not tie:
        return joined.select(*df.columns, *columns)
    # Of each task's runs of equal values only the first and the last can go on in another task.
    run = F.struct(*tie)
    joined = joined.select("*", *columns).withColumn("_end", F.max("rank0").over(Window.partitionBy(*group, "_task", *tie)) + 1)
    edge = joined.groupBy(*group, "_task").agg(F.min_by(F.struct(run.alias("run"), F.col("_end").alias("end")), "_id").alias("a"), F.max_by(F.struct(run.alias("run"), F.col("_end").alias("end")), "_id").alias("b"))
    edge = edge.select(*group, F.explode(F.array("a", "b")).alias("e")).groupBy(*group, F.col("e.run").alias("_run")).agg(F.max("e.end").alias("_last"))
    edge = saved(edge.select(*(F.col(g).alias(f"_g_{g}") for g in group), "_run", "_last"), "edges")  # two rows a task and group at most
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    whole = joined.join(edge, [*on, run.eqNullSafe(F.col("_run"))], "left")
    return whole.select(*df.columns, "rank0", "total", "dense", *(f"{c}_so_far" for c in sums), F.greatest("_end", F.coalesce("_last", F.col("_end"))).alias("tie_end"))


def ntile_of(rank0: Column, total: Column, k: int) -> Column:
    """The tile, from 1 to k, of a rank: the first total % k tiles hold one row more."""
    q, r = F.floor(total / k), F.pmod(total, F.lit(k))
    long_ = r * (q + 1)
    return F.when(rank0 < long_, F.floor(rank0 / (q + 1)) + 1).otherwise(F.floor((rank0 - long_) / F.greatest(q, F.lit(1))) + r + 1).cast("int")


def tile_starts(df: DataFrame, group: list[str], key: str, k: int) -> DataFrame:
    """(group, starts array): the keys at which tiles 2 to k of each group begin, so that a row's tile is one more than the number of starts
    not above its key. Only group and key are shuffled, so wide rows need not be. Keys are unique within a group."""
    dealt, heads = _tasks(df.select(*group, key), group, [F.col(key)])
    q, r = F.floor(F.col("_total") / k), F.pmod(F.col("_total"), F.lit(k))
    tiles = heads.withColumn("_tile", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    start = F.when(F.col("_tile") < r, F.col("_tile") * (q + 1)).otherwise(r * (q + 1) + (F.col("_tile") - r) * q)
    tiles = tiles.withColumn("_at", start).where("_at >= _before and _at < _before + _n and _at < _total")
    wanted = tiles.select((F.col("_first") + F.col("_at") - F.col("_before")).alias("_id"))
    wanted = saved(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = dealt.join(wanted, "_id").groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("starts"))
    return found  # at most k - 1 keys a group


def running_sums(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds for each column c `c_before` (the sum over earlier rows of the group) and `c_total` (over all its rows). `order` is unique in its
    group, ascending."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *[F.col(g) for g in group], F.col(order)).withColumn("_task", F.spark_partition_id())
    dealt = saved(dealt, "dealt")
    heads = dealt.groupBy(*group, "_task").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*group, "_task", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_b") for c in columns), *(F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in columns))
    local = Window.partitionBy(*group, "_task").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(heads, [*group, "_task"])
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_{c}_b")).alias(f"{c}_before") for c in columns), *(f"{c}_total" for c in columns))
