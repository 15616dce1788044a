"""Stored tables that are changed by key, a few files at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.sources.commits import CommitLog
from adloom.sources.work import saved


class KeyedTable:
    """A table in buckets by a hash of its keys. A change writes new versions of the buckets that it touches, beside the old ones, and a commit makes
    them current, all at once: readers see the table before or after it. Of two changes at once that touch a bucket, the later one is
    made anew on what the earlier one left; others don't disturb each other. Old versions stay, for those who still read them, until
    `drop_old`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.log = CommitLog(spark, f"{path}/log", "commit long, bucket int, version string", ("bucket",))

    def _current(self) -> dict[int, str]:
        """Of each bucket with rows its version."""
        return {r["bucket"]: r["version"] for r in self.log.states().collect()}  # a row a bucket

    def _of(self, versions: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(versions.items()) if v]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self._current())

    def change(self, incoming: DataFrame | None, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> int:
        """Puts merge(rows, incoming) in place of the rows of the buckets that incoming's keys fall in, of all buckets without incoming; returns how many
        buckets were written. merge makes of a key's rows rows of that key."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        if incoming is not None:
            incoming = saved(incoming, "incoming")
            touched = {r["bucket"] for r in incoming.select(bucket.alias("bucket")).distinct().collect()}  # no more than there are buckets
        while True:
            current = self._current()
            own = {b: v for b, v in current.items() if incoming is None or b in touched}
            version = uuid.uuid4().hex
            folder = f"{self.path}/data/{version}"
            merge(self._of(own), incoming).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
            wanted = sorted(own if incoming is None else touched)
            rows = [{"bucket": b, "version": version if self.log.exists(f"{folder}/bucket={b}") else ""} for b in wanted]

            def decide(states: DataFrame) -> list[dict]:
                now = {r["bucket"]: r["version"] for r in states.where(F.col("bucket").isin(wanted)).collect()}
                return rows if all(now.get(b) == own.get(b) for b in wanted) else []

            if not rows or self.log.append(decide):
                return len(rows)
            self.log.delete(folder)

    def drop_old(self) -> int:
        """Deletes all versions of buckets that aren't current; returns how many."""
        current, gone = self._current(), 0
        for r in self.log.entries().select("bucket", "version").distinct().collect():
            path = f"{self.path}/data/{r['version']}/bucket={r['bucket']}"
            if r["version"] and current.get(r["bucket"]) != r["version"] and self.log.exists(path):
                self.log.delete(path)
                gone += 1
        return gone
