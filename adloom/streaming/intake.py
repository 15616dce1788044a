"""Source files taken in as they arrive, each content once.

A store has its tables, partitioned by batch_id, and a commit log. Batch ids are a sequence of the store's own, given out by the log, so
any number of streams, inboxes and checkpoints can bring files into one store. A micro-batch is known by its stream's id and epoch: if it comes
again, after a failure or because the checkpoint didn't note its end, it finds its batch and writes the same partitions, or does
nothing if it was committed. Files are told apart by their full path and known again by a digest of their rows, also within one micro-batch. What
isn't committed isn't read: `table` gives the rows of committed batches only.

Files leave the inbox when their batch is committed and the checkpoint has noted their epoch, so a micro-batch that is repeated finds
its files. A stream doesn't see a file that comes later under a path that it has already read (within the file source's maxFileAge).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adloom.functions.columns import CATEGORICAL, NUMERIC, source_schema
from adloom.operators import marts, staging, warehouse
from adloom.operators.tables import content_digest, replace_batch
from adloom.sources.files import load_raw
from adloom.sources.commits import CommitLog

COLUMNS = [c.upper() for c in NUMERIC + CATEGORICAL]

#: Contents with these statuses are not processed again; others, such as FAILED, are.
DONE = ("QUALITY_CHECKED", "ARCHIVED")
#: Of a file's status, that after its file has been moved away.
MOVED = {"QUALITY_CHECKED": "ARCHIVED", "DUPLICATE": "DUPLICATE_ARCHIVED", "FAILED": "FAILED_FILE_MOVED"}


def incoming(spark: SparkSession, inbox: str, files: int = 1) -> DataFrame:
    """A stream of the inbox's csv files, oldest first, so many a micro-batch."""
    reader = spark.readStream.schema(source_schema()).option("header", True).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files).option("latestFirst", False)
    return reader.csv(inbox).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def log_of(spark: SparkSession, store: str) -> CommitLog:
    return CommitLog(spark, f"{store}/log")


def registry(spark: SparkSession, store: str) -> DataFrame:
    """The files that have come, with their batches and last statuses."""
    return log_of(spark, store).states()


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The committed batches of a table: staging, or marts/ and the mart's name."""
    ids = registry(spark, store).where(F.col("batch_status").isin(*DONE)).select("batch_id").distinct()
    return spark.read.parquet(f"{store}/{name}").join(F.broadcast(ids), "batch_id", "left_semi")


def set_status(spark: SparkSession, store: str, batch_id: int, status: str) -> None:
    """Gives a batch another status, such as ARCHIVED or FAILED."""
    log_of(spark, store).append(lambda states: [r.asDict() | {"batch_status": status} for r in states.where(F.col("batch_id") == batch_id).collect()])


def _write(batch: DataFrame, batch_id: int, store: str) -> None:
    spark = batch.sparkSession
    replace_batch(staging.build(load_raw(batch, batch_id)), f"{store}/staging")
    staged = spark.read.parquet(f"{store}/staging").where(F.col("batch_id") == batch_id)
    days = warehouse.dim_event_day(staged)
    fact = warehouse.fact_ad_events(staged, days)
    for name, mart in (("overall", marts.batch_overall(fact)), ("event_day", marts.batch_event_day(fact, days)), ("bucket", marts.batch_numeric_bucket(staged)), ("feature", marts.batch_feature(staged)), ("missing", marts.batch_missing(fact)), ("interaction", marts.batch_interactions(staged))):
        replace_batch(mart, f"{store}/marts/{name}")


def process(batch: DataFrame, epoch: int, store: str, query: str = "", go_on: bool = False) -> int:
    """Puts one micro-batch through staging and the batch marts, but for files whose content was processed before and is done; returns how many files
    were new. go_on: a batch that fails is registered as FAILED and no error is raised.

    The log gets the batch before its tables are written and again when they are. Of two batches that bring one content at once, the one
    that commits first has it; the other is written again without it. A micro-batch of no files gives no batch.
    """
    spark, log = batch.sparkSession, log_of(batch.sparkSession, store)
    if "source_path" not in batch.columns:
        batch = batch.withColumn("source_path", F.col("source_file"))
    files = [r.asDict() for r in content_digest(batch, ["source_path", "source_file"], ["label", *COLUMNS]).orderBy("source_path").collect()]  # a row a file of the micro-batch

    def known(states: DataFrame, batch_id: int) -> set[str]:
        others = states.where((F.col("batch_id") != batch_id) & F.col("batch_status").isin(*DONE) & F.col("digest").isin([f["digest"] for f in files]))
        return {r["digest"] for r in others.select("digest").collect()}

    def begin(states: DataFrame) -> list[dict]:
        own = states.where((F.col("query") == query) & (F.col("epoch") == epoch)).select("batch_id", "batch_status").collect()
        if not files or any(r["batch_status"] not in ("STARTED", "FAILED") for r in own):
            return []
        batch_id = own[0]["batch_id"] if own else (states.agg(F.coalesce(F.max("batch_id"), F.lit(0))).first()[0] + 1)
        seen, rows = known(states, batch_id), []
        for f in files:
            rows.append(f | {"batch_id": batch_id, "query": query, "epoch": epoch, "batch_status": "DUPLICATE" if f["digest"] in seen else "STARTED"})
            seen.add(f["digest"])
        return rows

    while True:
        begun = [r for r in log.append(begin) if r["batch_status"] == "STARTED"]
        if not begun:
            return 0
        batch_id, paths = begun[0]["batch_id"], [r["source_path"] for r in begun]
        try:
            _write(batch.where(F.col("source_path").isin(paths)).drop("source_path"), batch_id, store)
        except Exception:
            log.append(lambda states: [r | {"batch_status": "FAILED"} for r in begun])
            if go_on:
                return 0
            raise
        if log.append(lambda states: [] if known(states, batch_id) & {r["digest"] for r in begun} else [r | {"batch_status": "QUALITY_CHECKED"} for r in begun]):
            return len(begun)


def move_done(spark: SparkSession, store: str, archive: str, failed: str | None = None, query: str | None = None, before: int | None = None) -> int:
    """Moves the files of committed batches, and those that only repeat a known content, to the archive, and those of failed ones to `failed`; the
    registry gets their new places. query, before: only of this stream, and of its epochs before that one. Returns how many files were moved."""
    log = log_of(spark, store)
    due = log.states().where(F.col("batch_status").isin([s for s in MOVED if s != "FAILED" or failed]))
    if query is not None:
        due = due.where(F.col("query") == query)
    if before is not None:
        due = due.where(F.col("epoch") < before)
    rows = [r.asDict() for r in due.orderBy("batch_id", "source_path").collect()]  # files that haven't been moved yet
    if rows:
        rows = [r | {"archive_path": log.move(r["source_path"], failed if r["batch_status"] == "FAILED" else archive), "batch_status": MOVED[r["batch_status"]]} for r in rows]
        log.append(lambda states: rows)
    return sum(r["archive_path"] is not None for r in rows)


def run(spark: SparkSession, inbox: str, store: str, checkpoint: str, archive: str | None = None, failed: str | None = None, files: int = 1) -> StreamingQuery:
    """Processes all files that are in the inbox and ends; the checkpoint remembers which were seen. With archive, files leave the inbox: those of an
    epoch when the next one begins, the last ones at the end. With failed, batches that fail leave it too, for that folder, and the stream goes on."""

    def name() -> str:
        return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]

    def one(batch: DataFrame, epoch: int) -> None:
        if archive:
            move_done(spark, store, archive, failed, name(), epoch)
        process(batch, epoch, store, name(), failed is not None)

    query = incoming(spark, inbox, files).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if archive:
        move_done(spark, store, archive, failed, name())
    return query
