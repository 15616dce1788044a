"""Places for intermediate tables, and helpers that several operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext.getCheckpointDir()
        if have:
            return have
        base = f"file://{tempfile.mkdtemp(prefix='spark-adloom-')}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def ship(spark: SparkSession) -> None:
    """Makes the package known to Python workers that can't import it from where they run, once a session."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in map(os.path.abspath, filter(None, known)) or getattr(context, "_adloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-adloom-")
    context.addPyFile(shutil.make_archive(f"{folder}/adloom", "zip", root, "adloom"))
    context._adloom_shipped = True


#: In a worker: how to empty the memory that an operator keeps between tasks, and the operator whose task was the last.
_MEMORIES: dict[str, Callable[[], None]] = {}
_LAST: list[str] = [""]


def task_of(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Said by a task when it begins. A worker goes on with tasks of other operators later; what those before it kept is let go."""
    if _LAST[0] != operator:
        for name, empty in _MEMORIES.items():
            if name != operator:
                empty()
        _LAST[0] = operator
    if forget is not None:
        _MEMORIES[operator] = forget


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1,000 at a time instead of 10,000, unless the session has a setting of its own: a batch is held by the JVM and
    by the worker at once, more than once over while it is worked on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the written table, which survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.saved_path = path
    _written(spark).append(path)
    return written


def _written(spark: SparkSession) -> list[str]:
    """The intermediate tables of the session that are still there."""
    context = spark.sparkContext
    if not hasattr(context, "_adloom_written"):
        context._adloom_written = []
    return context._adloom_written


def mark(spark: SparkSession) -> int:
    """A place in the order of intermediate tables, for drop_saved."""
    return len(_written(spark))


def drop_saved(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables written since that mark. Results that are computed from them must have been written before."""
    for path in _written(spark)[since:]:
        _delete(spark, path)
    del _written(spark)[since:]


def drop(df: DataFrame) -> None:
    """Deletes the table that `saved` has returned."""
    _delete(df.sparkSession, df.saved_path)
    _written(df.sparkSession).remove(df.saved_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more than one of so many rows is hot; there are fewer hot keys than this, whatever the number of rows.
HOT = 4096


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], rows: int, hot: int = HOT) -> DataFrame:
    """The inner join of big with small (keys, n, ...), in which each key is once and n counts its rows in big, of `rows` in all. Hot keys, fewer
    than `hot`, are broadcast, so that their rows stay where they are; the others are joined by a shuffle."""
    few, many = (small.where(c).drop("n") for c in (F.col("n") * hot > rows, F.col("n") * hot <= rows))
    return big.join(F.broadcast(few), keys).unionByName(big.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream of batches, sorted by the long columns `keys`, so that no group of equal keys is split.

    Held back is one group at most beside the current batch, so memory is bounded by the largest group.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(b.schema.get_field_index(k))) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(b)
            continue
        cut = int(cuts[-1])
        held.append(b.slice(0, cut))
        yield pa.Table.from_batches([x for x in held if x.num_rows])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def batch_of(columns: dict[str, list | np.ndarray | pa.Array], schema: T.StructType) -> pa.RecordBatch:
    """A record batch of `schema`'s columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in fields], schema=fields)
