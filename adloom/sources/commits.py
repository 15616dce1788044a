"""An append-only commit log, one file a commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a commit of a store of batches says of a file. query and epoch: of the stream that brought it, by which a replayed micro-batch finds its batch again.
SCHEMA = "commit long, batch_id long, query string, epoch long, digest string, source_path string, source_file string, row_count long, batch_status string, archive_path string"


class CommitLog:
    """Commits are numbered from 1. A commit's file gets its name by a rename that fails where the name is taken, so of two writers one wins;
    the other decides anew on what the log holds then. Readers see a commit whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, keys: tuple[str, ...] = ("batch_id", "source_path")) -> None:
        """keys: what an entry is about; its state is what the newest commit says of it. schema begins with the number of the commit."""
        jvm = spark._jvm
        self.spark, self._path, self.schema, self.keys = spark, jvm.org.apache.hadoop.fs.Path, schema, keys
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(self._path(path))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the newest commit, 0 without any."""
        if not self._fs.exists(self.folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self.folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def entries(self) -> DataFrame:
        """All that was ever committed. A log that can't be read is an error, not an empty log."""
        if not self.last():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(self.folder.toString())

    def states(self) -> DataFrame:
        """What the log says last of each key."""
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("commit"))
        return self.entries().withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")

    def append(self, decide: Callable[[DataFrame], list[dict]]) -> list[dict]:
        """Commits what decide says on the states as they are; nothing, if that is empty. decide is asked again if another writer was faster."""
        while True:
            number = self.last() + 1
            rows = [r | {"commit": number} for r in decide(self.states())]
            if not rows or self._put(number, "\n".join(map(json.dumps, rows))):
                return rows

    def _put(self, number: int, text: str) -> bool:
        part = self._path(self.folder, f".{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._context.rename(part, self._path(self.folder, f"{number:020d}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def copy(self, source: str, folder: str) -> None:
        """Copies a file into a folder under its own name."""
        conf, path, to = self.spark._jsc.hadoopConfiguration(), self._path(source), self._path(folder)
        fs = path.getFileSystem(conf)
        fs.mkdirs(to)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, fs, self._path(to, path.getName()), False, conf)

    def move(self, source: str, folder: str) -> str | None:
        """Moves a file into a folder, under a name with a number where its own is taken. Returns the new path; None if the file isn't there."""
        path = self._path(source)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        to = fs.makeQualified(self._path(folder))
        fs.mkdirs(to)
        stem, dot, suffix = path.getName().rpartition(".")
        names = (path.getName() if not k else f"{stem or suffix}_{k}{dot}{suffix if stem else ''}" for k in range(1 << 30))
        target = next(t for t in (self._path(to, n) for n in names) if not fs.exists(t))
        if not fs.rename(path, target):
            raise OSError(f"{source} can't be moved to {target.toString()}")
        return target.toString()
