"""I-Match document fingerprints over randomised lexicons.

Method. A term's document frequency is counted over the whole corpus; the lexicon holds the terms whose inverse document frequency
lies within a chosen band. A document keeps its distinct terms that are in the lexicon, in sorted order. Randomised subsets of the
lexicon are fixed in advance by hashes of the terms: LEXICONS families, each of subsets that keep 1, 1/2, 1/4 ... of the terms, nested.
A document's I-Match hash over a subset is that of its sorted terms in it. Of each family the fingerprint holds one of these hashes: over
the thinnest subset that has any of the document's terms. Nothing is lost by that: over thinner ones the document has no terms, so two
documents agree in a family, as far as either has terms, just where their hashes over the thinnest subset that either has terms in are
equal, and that is where the hashes that the fingerprints hold are equal. So documents agree where they have the same terms in a subset
thin enough for them, whatever else they hold. The likeness of two fingerprints is the share of families in which they agree.
Equal texts have equal terms and so equal fingerprints.

A text none of whose terms are in the lexicon is hashed over all its terms; null texts, empty texts and texts without terms share one
fingerprint. Texts of any length are taken whole. Rows without doc_id come first in the order of documents; rows that repeat a doc_id follow each other in an order
set by a hash of their text. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, shuffle_partitions, struct_of

TERM = re.compile(r"\w+")
#: Randomised lexicons.
LEXICONS = 32
#: Shares of all documents in which a term of the band occurs, least and most.
BAND = (0.001, 0.3)
#: Distinct terms counted in a task before they are passed on.
HELD = 500_000


def terms(text: str) -> list[str]:
    """The distinct terms in sorted order."""
    return sorted(set(TERM.findall(text.lower())))


def term_hash(term: str) -> int:
    """Terms are counted and looked up by this number, 64 bits."""
    return xxhash.xxh64_intdigest(term)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The hashes of the terms in the band, sorted. A term must also be in two documents.

    Over n documents with d distinct terms each on average, at most d / band[0] terms can each be in a share band[0] of them, whatever
    n is: a thousand times d for BAND, so 8,000 bytes times d (2.4 MB for texts of 300 distinct terms, 80 MB for texts of 10,000). That
    bound is what allows the list to be collected, as one Arrow column, and sent to every executor.
    """
    out = struct_of("term long, n int")

    def counted(counts: Counter[str]) -> pa.RecordBatch:
        terms = np.fromiter(map(term_hash, counts), np.uint64, len(counts)).view(np.int64)
        order = np.argsort(terms)
        return batch_of({"term": terms[order], "n": np.fromiter(counts.values(), np.int32, len(counts))[order]}, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(set(TERM.findall((text.as_py() or "").lower())))
                if len(counts) >= HELD:
                    yield counted(counts)
                    counts.clear()
        if counts:
            yield counted(counts)

    n = docs.count()
    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, out).groupBy("term").agg(F.sum("n").alias("n"))
    found = sums.where(F.col("n").between(max(2, band[0] * n), band[1] * n)).select("term").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


class Fingerprinter:
    """Hashes texts over the randomised lexicons."""

    def __init__(self, words: np.ndarray, lexicons: int = LEXICONS) -> None:
        """words: hashes of the lexicon's terms."""
        self.words = words
        self.seeds = np.array([xxhash.xxh64_intdigest(f"lexicon {i}") for i in range(lexicons)], np.uint64)
        self.known: set[int] | None = None

    def _level(self, h: np.ndarray) -> np.ndarray:
        """For each term and lexicon, of the nested subsets the thinnest that holds the term: subset k holds 2**-k of all terms."""
        x = h[:, None] ^ self.seeds[None, :]
        for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(multiplier)
        x ^= x >> np.uint64(31)
        return np.bitwise_count(~x & (x - np.uint64(1)))

    def hashes(self, text: str | None) -> np.ndarray:
        """uint32, one for each lexicon."""
        found = terms(text or "")
        if not found:
            return np.zeros(len(self.seeds), np.uint32)
        if self.known is None:
            self.known = set(self.words.tolist())
        every = list(map(term_hash, found))
        own = [i for i, x in enumerate(every) if x in self.known] or range(len(found))
        h = np.array([every[i] for i in own], np.uint64)
        levels = self._level(h)
        term, place = np.nonzero((levels == levels.max(axis=0)).T)[::-1]
        kept: list[list[str]] = [[] for _ in self.seeds]
        for i, j in zip(term.tolist(), place.tolist()):
            kept[j].append(found[own[i]])
        return np.array([xxhash.xxh32_intdigest(" ".join(k)) for k in kept], np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal hashes."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare(docs: DataFrame, band: tuple[float, float] = BAND, lexicons: int = LEXICONS) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): the fingerprint of
    each text, that of the text with its last quarter replaced by the beginning of the next document's, and the likeness to the
    edited text's and to the next document's fingerprint. Documents are in ascending order of doc_id; after the last comes the first.

    Texts are shuffled once, by ranges of doc_id that are cut at quantiles. Each task passes over its ranges in order; the first row of
    a range is also sent to the range before it, where it follows the last row. The driver gets the cuts and those first ids: a
    few numbers for each task.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Fingerprinter(lexicon(docs, band), lexicons))
    parts = shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    cuts = sorted({int(c) for c in texts.approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts)})
    place = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    texts = texts.withColumn("part", F.size(F.filter(place, lambda c: c <= F.col("key")))).withColumn("nth", F.xxhash64("text"))
    # The quantiles are of rounded numbers, so where ranges begin is taken from the rows themselves.
    firsts = texts.groupBy("part").agg(F.min("key").alias("key")).collect()
    begin = sorted((r["part"], r["key"]) for r in firsts)
    before = {k: p for (_, k), (p, _) in zip(begin[1:] + begin[:1], begin)}  # of a range's first id the range that it follows
    follows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p).alias("part")) for k, p in before.items()))
    copies = texts.where(F.col("key").isin(list(before))).withColumn("to", F.explode(F.filter(follows, lambda f: f["key"] == F.col("key")))) if before else None
    rows = texts.select("part", F.lit(0).alias("tail"), "key", "nth", "doc_id", "text")
    if copies is not None:
        rows = rows.unionByName(copies.select(F.col("to.part").alias("part"), F.lit(1).alias("tail"), "key", "nth", "doc_id", "text"))
    rows = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "tail", "key", "nth")
    out = struct_of("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def finish(doc_id: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
        changed = edited(text, following)
        other = own if changed == text else known.value.hashes(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), likeness(own, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = None, None  # last: the row that waits for the next
        for b in batches:
            found = []
            for p, tail, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                if tail and (last is None or p != part):
                    continue  # of several first rows with one id, the first follows
                text = text.as_py()
                own = known.value.hashes(text)
                if last is not None:
                    found.append(finish(*last, text, own))
                part, last = p, None if tail else (doc_id, text, own)
            if found:
                yield batch_of(dict(zip(out.fieldNames(), map(list, zip(*found)))), out)

    return rows.mapInArrow(run, out)
