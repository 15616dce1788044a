"""Removal of passages that repeat across documents, by hashing units of text.

Method. Texts are cut into units: lines, and within lines sentences, so that a passage inside a longer line is found too. Units
are normalised (case folded, white space collapsed), digested to 128 bits and grouped by digest over the whole corpus. The
earliest occurrence, in order of doc_id and then of place, stays. Of later ones whole lines go whatever their length, and sentences
where they form a run of at least `min_words` words of repeated units (shorter ones repeat by chance and stay).

A passage may begin and end inside sentences, so runs of WINDOW words are units too. Of each document those are digested that have the
least digest of some STEP in a row: whatever the text around it, any WINDOW + STEP - 1 words in a row hold one, and neighbouring ones
leave no word between them out. Of a repeated passage less than STEP words stay at each end, and only where no repeated sentence or
line covers them. The offsets of all that is removed, in code points of the original text, are kept beside the text.

Null texts stay null, with no spans; empty texts stay empty. Rows without doc_id rank last, each a document by itself, also where they
repeat a text. Rows that repeat a doc_id count as one document: units that they share with each other are not repeats. Repeats of lines
and sentences within one text are; of a window that only one text has, nothing is cut. Other columns pass through unchanged. A column
named `removed` in the input is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.llm.common import HOT, batch_of, join_counted, saved, struct_of, task_of

#: Ends of units: line ends, and white space after a sentence's last mark.
BREAK = re.compile(r"\n\s*|(?<=[.!?])[^\S\n]+")
#: Words of repeated sentences in a row from which they are removed.
MIN_WORDS = 5
#: Words of a window, and how many windows in a row have one that is chosen; with STEP <= WINDOW chosen ones leave no gaps.
WINDOW, STEP = 25, 25
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD = re.compile(r"\S+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _digest(text: str) -> bytes:
    """128 bits, of which one is clear: windows have it set."""
    d = xxhash.xxh3_128_digest(text)
    return d[:8] + bytes([d[8] & 0xFE]) + d[9:]


def units(text: str) -> Iterator[tuple[int, int, bytes, int]]:
    """start, end (with the break after it), digest and words of each sentence that has words."""
    at = 0
    for m in BREAK.finditer(text):
        words = text[at : m.start()].casefold().split()
        if words:
            yield at, m.end(), _digest(" ".join(words)), len(words)
        at = m.end()
    words = text[at:].casefold().split()
    if words:
        yield at, len(text), _digest(" ".join(words)), len(words)


def lines(text: str, below: int) -> Iterator[tuple[int, int, bytes]]:
    """start, end (with the line ends after it) and digest of each line of fewer than `below` words, but some. Longer lines go by their
    sentences."""
    at = 0
    for m in re.finditer(r"\n\s*|$(?!\n)", text):
        words = text[at : m.start()].casefold().split()
        if 0 < len(words) < below:
            yield at, m.end(), _digest("\n" + " ".join(words))
        at = m.end()


@lru_cache(2)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64 and of its inverse."""
    out = []
    for x in (factor, pow(factor, -1, 1 << 64)):
        p = np.full(size, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def windows(text: str) -> np.ndarray:
    """The digests of all runs of WINDOW words, (n, 2) signed: polynomials of the words' hashes, from running sums."""
    words = text.casefold().split()
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros((0, 2), np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.empty((n, 2), np.uint64)
    for i, factor in enumerate(FACTORS):
        up, down = _powers(factor, 1 << max(14, len(words).bit_length()))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(h * down[: len(words)], out=sums[1:])
        own = (sums[WINDOW:] - sums[:-WINDOW]) * up[:n]
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = own ^ (own >> np.uint64(29))
    out[:, 1] |= np.uint64(1)
    return out.view(np.int64)


def chosen(digests: np.ndarray) -> np.ndarray:
    """The places of the windows that are least among some STEP in a row, the first of equal ones."""
    if not len(digests):
        return np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(digests[:, 0], min(STEP, len(digests)))
    return np.unique(rows.argmin(axis=1) + np.arange(len(rows)))


def cut(text: str, repeated: set[bytes], min_words: int, repeated_windows: np.ndarray | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The text without its repeats, and their spans. repeated: digests that an earlier document has; repeated_windows: the first halves
    of those of windows."""
    seen: set[bytes] = set()
    spans: list[tuple[int, int]] = []
    for a, b, digest in lines(text, min_words):
        if digest in repeated or digest in seen:
            spans.append((a, b))
        seen.add(digest)
    if repeated_windows is not None and len(repeated_windows):
        digests = windows(text)
        at = chosen(digests)
        hit = at[np.isin(digests[at, 0], repeated_windows)].tolist()
        places = [m.span() for m in WORD.finditer(text)] if hit else []
        for i in hit:
            end = places[i + WINDOW - 1][1]
            while end < len(text) and text[end] != "\n" and text[end].isspace():
                end += 1
            spans.append((places[i][0], end))
    start, end, words = 0, 0, 0
    for a, b, digest, n in units(text):
        if digest in repeated or digest in seen:
            if not words:
                start = a
            end, words = b, words + n
        else:
            if words >= min_words:
                spans.append((start, end))
            words = 0
        seen.add(digest)
    if words >= min_words:
        spans.append((start, end))
    found, spans = sorted(spans), []
    for a, b in found:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), spans


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, any others). Returns its columns with text cut, and removed array<struct<start, end>>.

    A row of docs gives a row. Digests are counted map-side first, so a unit in a third of all documents is a few rows. Its later
    occurrences are found by a broadcast of the hot digests, fewer than HOT; those of all others by a join in which each key has at
    most one of HOT rows. What is collected for a document are its own repeated digests.
    """
    rest = [c for c in docs.columns if c not in ("text", "removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string"), F.col("doc_id").cast("long").alias("doc"))
    nameless = rows.where("doc is null")
    if not nameless.isEmpty():  # these are written once, so that their ranks are the same whenever they are read
        nameless = saved(nameless.withColumn("doc", F.lit(1 << 62) + F.monotonically_increasing_id()), "nameless")
        rows = rows.where("doc is not null").unionByName(nameless)
    out = struct_of("doc bigint, h1 bigint, h2 bigint")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("substrings")
        for b in batches:
            doc, found = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            rows: list[int] = []
            parts: list[bytes] = []
            for i, x in enumerate(found):
                text = x.as_py() or ""
                own = {u[2] for u in units(text)} | {u[2] for u in lines(text, min_words)}
                w = windows(text)
                w = w[chosen(w)].tobytes()
                own.update(w[j : j + 16] for j in range(0, len(w), 16))
                rows += [i] * len(own)
                parts += own
                if len(rows) > 200_000:
                    yield pack(doc, rows, parts)
                    rows, parts = [], []
            if rows:
                yield pack(doc, rows, parts)

    def pack(doc: np.ndarray, rows: list[int], parts: list[bytes]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
        return batch_of({"doc": doc[rows], "h1": h[:, 0].copy(), "h2": h[:, 1].copy()}, out)

    found = saved(rows.select("doc", "text").where("text is not null").mapInArrow(digests, out), "units")
    total = found.count()
    shared = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = saved(shared.where("first < last").select("h1", "h2", "first", "n"), "shared")
    later = join_counted(found, shared, ["h1", "h2"], total, HOT)
    later = later.where("doc > first").select("doc", "h1", "h2")
    later = later.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("repeated"))

    joined = rows.join(later, "doc", "left").select("rest", "text", "repeated")
    schema = T.StructType([*joined.schema["rest"].dataType.fields, joined.schema["text"], T.StructField("removed", SPAN)])
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("substrings")
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, offsets = lists.flatten(), None
            pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            texts, spans = [], []
            for i, x in enumerate(b.column(b.num_columns - 2)):
                text = x.as_py()
                if text is None:
                    texts.append(None)
                    spans.append([])
                    continue
                own = pairs[offsets[i] : offsets[i + 1]]
                of_window = (own[:, 1] & 1) == 1
                raw = own[~of_window].tobytes()
                text, removed = cut(text, {raw[j : j + 16] for j in range(0, len(raw), 16)}, min_words, own[of_window, 0])
                texts.append(text)
                spans.append([{"start": s, "end": e} for s, e in removed])
            columns = b.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), pa.array(texts, arrow.field("text").type), pa.array(spans, arrow.field("removed").type)], schema=arrow)

    return joined.mapInArrow(apply, schema).select(*[c for c in docs.columns if c != "removed"], "removed")
