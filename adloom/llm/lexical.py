"""Ranked lexical search by NRA: sorted reads only, with a lower and an upper bound of each document's score.

Index. Terms are counted in one pass over the texts, and written with a row for each document. Counts over all documents give the terms' weights; then
what each posting adds to its document's score, its impact, is known. The index is cut by documents: a shard holds some documents and,
of each term that the queries have, the list of its postings among them in order of falling impact. Shards are built and searched where
the counts are read, so no list is ever in one place and no posting is shuffled; each shard gives its best documents to each query, and those
few are merged.

Search. Lists of a query are read from their tops, all as deep, in steps. A document's lower bound is the sum of the impacts read; its
upper bound adds, for each term not read, the impact that comes next in that term's list. Once what is still to come in all lists
together is under the k-th lower bound, no new document can enter; from then on, of what is read only postings of candidates count, documents whose
upper bound reaches that mark. It ends when no document outside can pass or tie with those inside and their bounds are equal, so
membership, ties and scores are all final; at the latest when the lists end.

Each row of the documents is ranked by itself, also rows that repeat a doc_id or a text, and rows without doc_id (which come last of equal scores); null
and empty texts have no terms. Texts are counted whole. Rows of the queries that repeat an item_id are one query, rows without
item_id are none, and queries without terms, or whose terms no document has, find nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, saved, struct_of, task_of

#: How deep a search first reads in each list, and how many times as deep in each further step.
DEPTH, GROWTH = 256, 4
#: Postings of a shard, but for the last document's.
SHARD = 2_000_000
#: Pairs of a query and a term that are searched together; more are searched in several passes over the texts.
TOGETHER = 100_000
#: Letters and digits of ASCII and all that isn't ASCII make terms; capitals of ASCII become small.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

LAST = (1 << 63) - 1


def terms(text: bytes) -> list[bytes]:
    """All terms of a text, with repeats."""
    return text.translate(TABLE).split()


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (item_id, text). Returns (item_id, term binary): the distinct terms of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(terms(_bytes(x)))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), list(map(len, own))))), pa.array([t for x in own for t in x], pa.binary())], names=["item_id", "term"])

    rows = queries.where("item_id is not null").select("item_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.select("item_id", F.lit(None).cast("binary").alias("term")).schema).distinct()


def counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text). Returns (row, doc_id, n, terms, tf): of each row with any term how many terms it has, and how often it has the known ones."""
    sent, out = docs.sparkSession.sparkContext.broadcast(known), struct_of("row long, doc_id long, n long, terms array<int>, tf array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("lexical")
        known = sent.value
        for b in batches:
            at, n, found, tf = [], [], [], []
            for i, x in enumerate(b.column(2)):
                own = terms(_bytes(x))
                if not own:
                    continue
                counts = Counter(own)
                both = counts.keys() & known.keys()
                at.append(i)
                n.append(len(own))
                found.append([known[t] for t in both])
                tf.append([counts[t] for t in both])
            yield batch_of({"row": b.column(0).take(pa.array(at, pa.int64())), "doc_id": b.column(1).take(pa.array(at, pa.int64())), "n": n, "terms": found, "tf": tf}, out)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


class Shard:
    """Documents and their lists. order: where a document stands among those of equal scores."""

    def __init__(self, order: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> None:
        by = np.lexsort((-impact, term))
        self.order, self.doc, self.impact = order, doc[by], impact[by]
        self.begin = np.searchsorted(term[by], np.arange(size + 1))

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of a query and their scores, best first."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        n, depth, read = len(self.order), DEPTH, begin.copy()
        candidate, doc, impact, which = None, [], [], []
        while True:
            to = np.minimum(begin + depth, end)
            for j, (a, b) in enumerate(zip(read.tolist(), to.tolist())):
                d, x = self.doc[a:b], self.impact[a:b]
                if candidate is not None:
                    d, x = d[candidate[d]], x[candidate[d]]
                doc.append(d)
                impact.append(x)
                which.append(np.full(len(d), j))
            read = to
            coming = np.where(to < end, self.impact[np.minimum(to, len(self.impact) - 1)], 0) if len(self.impact) else np.zeros(len(terms), np.int64)
            doc, impact, which = [np.concatenate(doc)], [np.concatenate(impact)], [np.concatenate(which)]
            # Sums in doubles are exact: impacts are whole numbers under 2**36, and a query has under 2**17 terms.
            lower = np.bincount(doc[0], impact[0], n).astype(np.int64)
            upper = lower + int(coming.sum()) - np.bincount(doc[0], coming[which[0]], n).astype(np.int64)
            met = np.flatnonzero(lower > 0)
            bar = np.partition(lower[met], len(met) - k)[len(met) - k] if len(met) >= k else 0
            best = met[lower[met] >= bar]
            best = best[np.lexsort((self.order[best], -lower[best]))][:k]
            last = self.order[best[-1]] if len(best) == k else n
            inside = (lower > 0) & ((upper > bar) | ((upper == bar) & (self.order <= last)))
            if not coming.any():
                return best, lower[best]
            if int(coming.sum()) < bar:
                if int(inside.sum()) <= k and (upper[best] == lower[best]).all():
                    return best, lower[best]
                candidate = inside
                kept = inside[doc[0]]
                doc, impact, which = [doc[0][kept]], [impact[0][kept]], [which[0][kept]]
            depth *= GROWTH


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        lists = b.column(3)
        offsets = lists.offsets.to_numpy()
        at = 0
        while at < b.num_rows:
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD - size, "right")) - 1))
            held.append(b.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= SHARD or at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _best(counts: DataFrame, pairs: list[tuple[int, int]], items: int, known: int, k: int) -> DataFrame:
    """counts: of `counted`; pairs: query and term, by query. Returns (item, row, doc_id, score): the k best documents of each query in each shard."""
    context = counts.sparkSession.sparkContext
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n, length = total["n"], max(1, total["l"])
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row a term
    weight = np.zeros(known, np.int64)
    for t, d in zip(df["term"].to_pylist(), df["df"].to_pylist()):
        weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
    item, term = (np.array(x, np.int64) for x in zip(*pairs))
    queries = np.split(term, np.searchsorted(item, np.arange(1, items)))
    sent, out = context.broadcast((weight, queries)), struct_of("item int, row long, doc_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("lexical")
        weight, queries = sent.value
        for t in _shards(batches):
            t = t.combine_chunks()
            row, ids = t["row"].to_numpy(), t["doc_id"].fill_null(LAST).to_numpy()
            order = np.empty(len(row), np.int64)
            order[np.lexsort((row, ids))] = np.arange(len(row))
            m = 10 + (90 * t["n"].to_numpy() * n) // length
            lists = t["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(row)), lists.value_lengths().to_numpy())
            terms, tf = lists.flatten().to_numpy().astype(np.int64), t["tf"].combine_chunks().flatten().to_numpy()
            impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            some = impact > 0
            shard = Shard(order, doc[some], terms[some], impact[some], len(weight))
            found = [shard.search(q, k) for q in queries]
            at = np.concatenate([d for d, _ in found])
            yield batch_of({"item": np.repeat(np.arange(len(found)), [len(d) for d, _ in found]), "row": row[at], "doc_id": t["doc_id"].combine_chunks().take(pa.array(at)), "score": np.concatenate([s for _, s in found])}, out)

    return counts.mapInArrow(run, out)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """docs (doc_id, text), queries (item_id, text). Returns (item_id, rank int, doc_id, score long): of each query the k documents of highest
    score above 0, equal scores by ascending doc_id.

    A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); in a document of n terms, where m = 10 + 90 n N div L, a term that occurs tf
    times has the impact w * (10^9 tf div (1000 tf + 8 m)). N: documents with a term, L: all their terms, df: documents with this one.
    """
    spark = docs.sparkSession
    own = saved(query_terms(queries), "terms")
    passes = max(1, math.ceil(own.count() / TOGETHER))
    results = []
    for p in range(passes):
        pairs = own.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()  # about TOGETHER rows
        if not len(pairs):
            continue
        ids, words = pairs["item_id"].combine_chunks().dictionary_encode(), pairs["term"].combine_chunks().dictionary_encode()
        counts = saved(counted(docs, {t: i for i, t in enumerate(words.dictionary.to_pylist())}), "counts")
        best = _best(counts, sorted(zip(ids.indices.to_pylist(), words.indices.to_pylist())), len(ids.dictionary), len(words.dictionary), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids.dictionary)), pa.int32()), "item_id": ids.dictionary}))
        results.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    if not results:
        return queries.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, results)
