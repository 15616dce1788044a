"""WARC archives as a Python data source.

Writing: each task writes files of its own under new names into a folder that driver and executors share, beginning a new file
when one is large. The driver's commit adds a list of the files of the tasks that succeeded, so those of lost or repeated attempts are
never read; a task that fails and a job that is given up remove theirs. Appends add lists; an overwrite's list names the lists that it
replaces, and they and their files are removed after it is there. Reading: one partition for each listed file (for each *.warc and
*.warc.gz file where there is no list). Predicates on record_type and on header columns are pushed down: a record's headers are
parsed first, and where they don't satisfy the predicates, or the payload isn't asked for, the payload is passed over by its length
without being decoded: by a seek, or in compressed files by inflating it unseen.

Records are WARC/1.1, without compression or with each record a gzip member of its own. Null page ids make records without a page
number; null urls and payloads are empty; line ends and other control characters in a url are percent-encoded; bytes of headers that
aren't UTF-8 are replaced. An empty table gives an archive without records. A record is held in memory whole, others are not.
Files are reached through Arrow's file systems, by local path or URI.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from adloom.llm.common import new_path, saved, struct_of

#: Lists of files are called _records-<number>.json.
LIST = "_records-"
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Columns that come from one header each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_bytes": "x-payload-bytes"}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit (refers_to is set) has no payload, but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _lists(fs: pafs.FileSystem, base: str) -> dict[str, dict]:
    """The lists in force: name to {files, replaces}."""
    found = {}
    for x in fs.get_file_info(pafs.FileSelector(base)):
        if x.base_name.startswith(LIST) and x.base_name.endswith(".json"):
            with fs.open_input_stream(f"{base}/{x.base_name}") as f:
                found[x.base_name] = json.loads(f.read())
    gone = {name for one in found.values() for name in one["replaces"]}
    return {name: one for name, one in sorted(found.items()) if name not in gone}


def _remove(fs: pafs.FileSystem, base: str, names: list[str]) -> None:
    for name in names:
        if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.File:
            fs.delete_file(f"{base}/{name}")


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, gzip: bool) -> None:
        self.path, self.overwrite, self.gzip = path, overwrite, gzip

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows (page_id, url, html, bytes, sha, refers_to): sha is the payload's SHA-1 in hexadecimal digits, html null for revisits."""
        fs, base = _opened(self.path)
        fs.create_dir(base, recursive=True)
        files: list[str] = []
        out, written, done = None, 0, False
        try:
            for b in iterator:
                cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "bytes", "sha", "refers_to")]
                for page_id, url, html, size, sha, refers_to in zip(*cols):
                    if out is None or written >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                        out, written = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    data = record(page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode(), size.as_py(), digest, refers_to.as_py())
                    data = gzipped(data) if self.gzip else data
                    out.write(data)
                    written += len(data)
            done = True
        finally:
            if out is not None:
                out.close()
            if not done:
                _remove(fs, base, files)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _opened(self.path)
        fs.create_dir(base, recursive=True)
        old = _lists(fs, base) if self.overwrite else {}
        one = {"files": [x for m in messages if m is not None for x in m.files], "replaces": list(old)}
        name = f"{LIST}{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{base}/{name}.part") as f:
            f.write(json.dumps(one).encode())
        fs.move(f"{base}/{name}.part", f"{base}/{name}")
        _remove(fs, base, [*(x for o in old.values() for x in o["files"]), *old])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _opened(self.path)
        _remove(fs, base, [x for m in messages if m is not None for x in m.files])


class Plain:
    """A file's bytes in order; what is skipped isn't read."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.at, self.end = f, 0, f.size()

    def head(self) -> bytes | None:
        """All up to an empty line, which is passed over; null at the end of the file."""
        found, start, looked, size = bytearray(), self.at, 0, 1024
        self.f.seek(start)
        while (cut := found.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(found) - 3)
            more = self.f.read(size)
            size = min(2 * size, 1 << 24)
            if not more:
                if found.strip():
                    raise ValueError(f"a record at {start} has no end of headers")
                return None
            found += more
        self.at = start + cut + 4
        return bytes(found[:cut])

    def take(self, n: int) -> bytes:
        self.f.seek(self.at)
        self.at += n
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.at += n


class Inflated:
    """The same of a file of gzip members, which are read as one stream; what is skipped is inflated and dropped."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.inflate, self.held = f, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = data or self.f.read(1 << 16)
            if not data:
                return False
            if out := self.inflate.decompress(data, 1 << 20):
                self.held += out
                return True

    def head(self) -> bytes | None:
        held, looked = bytearray(self.held), 0
        while (cut := held.find(b"\r\n\r\n", looked)) < 0:
            looked, self.held = max(0, len(held) - 3), b""
            if not self._more():
                if held.strip():
                    raise ValueError("the last record has no end of headers")
                return None
            held += self.held
        self.held = bytes(held[cut + 4 :])
        return bytes(held[:cut])

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left > 0 and (self.held or self._more()):
            parts.append(self.held[:left])
            self.held = self.held[len(parts[-1]) :]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0 and (self.held or self._more()):
            dropped = min(n, len(self.held))
            self.held = self.held[dropped:]
            n -= dropped


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, schema: StructType) -> None:
        self.path, self.payload, self.schema = path, payload, schema
        self.wanted: list[tuple[str, set[str] | str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, IN and prefixes on header columns of strings; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and column != "payload_bytes":
                if isinstance(f, EqualTo) and isinstance(f.value, str):
                    self.wanted.append((column, {f.value}))
                    continue
                if isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                    self.wanted.append((column, set(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.wanted.append((column, f.value))
                    continue
                if isinstance(f, IsNotNull):
                    self.wanted.append((column, ""))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = _opened(self.path)
        lists = _lists(fs, base)
        if lists:
            names = [x for one in lists.values() for x in one["files"]]
        else:
            names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [File(x) for x in names] or [File("")]

    def _fits(self, values: dict[str, str | None]) -> bool:
        for column, wanted in self.wanted:
            value = values[column]
            if value is None or (not value.startswith(wanted) if isinstance(wanted, str) else value not in wanted):
                return False
        return True

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        if not partition.path:
            return
        fs, base = _opened(self.path)
        names = [f.name for f in arrow]
        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(f"{base}/{partition.path}") as f:
            stream = Inflated(f) if partition.path.endswith(".gz") else Plain(f)
            while (head := stream.head()) is not None:
                lines = head.decode(errors="replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{partition.path}: no record where one should begin")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length = int(fields["content-length"])
                values: dict[str, Any] = {c: fields.get(h) for c, h in HEADERS.items()}
                if not self._fits(values):
                    stream.skip(length + 4)
                    continue
                values["payload_bytes"] = None if values["payload_bytes"] is None else int(values["payload_bytes"])
                values["payload"] = None
                if self.payload and values["record_type"] != "revisit":
                    body = stream.take(length)
                    values["payload"] = body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body
                    size += length
                    stream.skip(4)
                else:
                    stream.skip(length + 4)
                rows.append(tuple(values[n] for n in names))
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows, arrow)

    @staticmethod
    def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class WarcSource(DataSource):
    """Options: path; payload (true): whether payloads are read at all; compression (none): gzip makes each record a member."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite, self.options.get("compression", "none").lower() == "gzip")


def register(spark: SparkSession) -> None:
    """Makes the format `warc` known to the session, and lets it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive, with the columns of SCHEMA. payload false: payloads are never read."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html). Returns (page_id, url, html, bytes, sha, refers_to), a row for each. Of the rows with the same payload of at
    least least_bytes bytes, refers_to is the largest page_id, null for one row that has it and for payloads that occur once; html is
    null where refers_to is set. Of rows that repeat the largest page_id the one with the least url stays, of equal ones any. Rows
    without page_id refer to the largest, if there is any.

    Payloads are counted by digest and id map-side, so the group of a payload in a third of all rows is a few rows. Equal rows are
    counted before one of them is picked.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("bytes"))
    ids = own.where(F.col("bytes") >= least_bytes).groupBy("sha", "page_id").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("sha").agg(F.max("page_id").alias("original"), F.sum("n").alias("n"), F.max_by(F.struct("n", "url"), "page_id").alias("top"))
    groups = saved(groups.where("n > 1 and original is not null").select("sha", "original", F.col("top.n").alias("same_id"), F.col("top.url").alias("first_url")), "payloads")
    joined = own.join(groups, "sha", "left")
    long_enough, at_top = F.coalesce(F.col("bytes") >= least_bytes, F.lit(False)), F.col("page_id").eqNullSafe(F.col("original"))
    refers = F.when(long_enough & (~at_top | ((F.col("same_id") > 1) & (F.col("url") != F.col("first_url")))), F.col("original"))
    columns = ["page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "bytes", "sha", refers.alias("refers_to")]
    if groups.where("same_id > 1").isEmpty():
        return joined.select(*columns)
    twin = F.coalesce(long_enough & at_top & (F.col("same_id") > 1) & (F.col("url") == F.col("first_url")), F.lit(False))
    twins = joined.where(twin).groupBy("page_id", "url", "bytes", "sha", "original").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
    twins = twins.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    twins = twins.select("page_id", "url", F.when(F.col("nth") == 1, F.col("html")).alias("html"), "bytes", "sha", F.when(F.col("nth") > 1, F.col("original")).alias("refers_to"))
    return joined.where(~twin).select(*columns).unionByName(twins)


def write(pages: DataFrame, path: str, mode: str = "append", least_bytes: int = 0, compression: str = "none") -> None:
    """Writes a record for each row of pages (page_id, url, html). Of equal payloads in pages one is a response, the others revisits of it."""
    register(pages.sparkSession)
    with_originals(pages, least_bytes).write.format("warc").option("compression", compression).mode(mode).save(path)


def archive(pages: DataFrame, least_bytes: int = 0, compression: str = "none") -> str:
    """The same into a new folder, which is returned."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, "append", least_bytes, compression)
    return path


def page_number(uri: str):
    """The page number in a column of <urn:page:N>; null where there is none."""
    return F.nullif(F.regexp_extract(uri, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive. Length and digest of responses are taken anew from the
    payload that was read; revisits are read by their headers alone."""
    out = struct_of("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for b in batches:
            payloads = [x.as_py() or b"" for x in b.column(1)]
            n = len(payloads)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, payloads), pa.int64()), pa.array(map(digest_of, payloads), pa.string()), pa.array(["response"] * n, pa.string()), pa.nulls(n, pa.int64())], schema=arrow)

    responses = read(spark, path).where("record_type = 'response'").select(page_number("record_id").alias("page_id"), "payload").mapInArrow(measure, out)
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'")
    revisits = revisits.select(page_number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
