"""Approximate nearest neighbours over balanced posting lists.

Method. Lists are learned in two levels, so that their number grows with the table and their size doesn't. A bounded sample is split
again and again in two equal halves; the parts' means are the cells' centroids, and a graph over them (each linked to near ones
that no nearer link hides) is small enough to be in every executor's memory. A beam search over the graph finds the cells of a
vector; it looks at some of them only, and goes on until the nearest cell beyond the ratio is found. Each cell then learns the
centroids of its posting lists, about LIST vectors each, in the same way from a bounded sample of its own. A vector is put into the list of
its nearest centroid, and also into those of further centroids that are about as near (boundary vectors), in its own cell and in
neighbouring ones. A query searches the lists whose centroid's distance is within a ratio of the nearest one's.
Both ratios are chosen on the sample: that of copies so that about SHARE of the vectors get one, that of the search so that a share
TARGET of the sample's own nearest neighbours is in the lists searched: as many of them as the k nearest of the table should have in the
sample, one at least.
Queries meet lists block by block: a list is cut into blocks of bounded size, each block gives its own nearest rows to each
query, and these few rows are merged.

Distances are Euclidean, in double precision, on the original vectors. Vectors that are null, zero or hold null or non-finite
components take no part, nor do those whose length isn't the most frequent one (the longest, among equally frequent). Rows without
vec_id take no part. Rows that repeat a vec_id are candidates by themselves, of which the nearest counts. Equal scores go to the
smaller vec_id. Columns besides vec_id and embedding are ignored. No vectors or no queries give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, saved, shuffle_partitions, struct_of, whole_groups

#: Vectors that the cells are learned from, and those that the lists of one cell are, at most about; and bytes of such a sample.
SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
#: Vectors to a list, on average, and cells at most. While there are no more lists than cells each cell is a list; with more vectors
#: cells have more lists.
LIST, CELLS = 128, 1_250
#: Times that centroids are moved to the means of what is nearest to them, after the halving.
MOVES = 4
#: Rows of a cell, rows of a block of a list, and queries to it that are handled together.
PIECE, BLOCK, CUT = 4_096, 1_024, 8_192
#: Lists of its own cell and cells that a vector is put into at most, how much farther than the nearest they may be at most, and the share
#: of vectors that should get a copy.
COPIES, COPY_RATIO, SHARE = 2, 1.1, 0.1
#: Vectors of the sample that are asked to choose the search's ratios, and the shares of their neighbours that must be in the cells and lists.
ASKED, IN_CELLS, TARGET = 512, 0.99, 0.94
#: Rows found that a task holds.
HELD = 250_000
#: Links of a centroid, and candidates that a search of the graph holds at first; it holds twice as many while all are within the ratio.
LINKS, BEAM = 24, 16


def _halves(x: np.ndarray, rows: np.ndarray, cell: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Parts of at most `cell` rows, each split in the middle along the line between two means."""
    stack = [rows]
    while stack:
        part = stack.pop()
        if len(part) <= cell:
            yield part
            continue
        own = x[part]
        a, b = own[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = own @ (a - b)
            near = np.argsort(-side, kind="stable")
            a, b = own[near[: len(part) // 2]].mean(axis=0), own[near[len(part) // 2 :]].mean(axis=0)
        near = np.argsort(-(own @ (a - b)), kind="stable")
        stack += [part[near[: len(part) // 2]], part[near[len(part) // 2 :]]]


def centroids(sample: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """The means of about that many equal parts of a sample of at least one row."""
    size = max(1, -(-len(sample) // max(1, parts)))
    centre = np.array([sample[p].mean(axis=0) for p in _halves(sample, np.arange(len(sample)), size, np.random.default_rng(seed))], np.float32)
    for _ in range(MOVES if len(centre) > 1 else 0):
        norm = (centre**2).sum(axis=1)
        near = np.concatenate([(norm - 2 * (sample[at : at + 2048] @ centre.T)).argmin(axis=1) for at in range(0, len(sample), 2048)])
        order = np.argsort(near, kind="stable")
        begin = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
        centre[near[order][begin]] = np.add.reduceat(sample[order], begin, axis=0) / np.diff(np.append(begin, len(order)))[:, None]
    return centre


class Graph:
    """Centroids and the graph that leads to them."""

    def __init__(self, centre: np.ndarray) -> None:
        self.centre = centre
        self.norm = (self.centre.astype(np.float64) ** 2).sum(axis=1)
        n = len(self.centre)
        self.links = np.zeros((n, min(LINKS, max(n - 1, 1))), np.int32)
        for i in range(n):
            d = self.norm + self.norm[i] - 2 * (self.centre @ self.centre[i]).astype(np.float64)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(4 * LINKS, n - 1)]
            kept: list[int] = []
            for j in near.tolist():
                if len(kept) == self.links.shape[1]:
                    break
                between = self.norm[kept] + self.norm[j] - 2 * (self.centre[kept] @ self.centre[j]) if kept else np.array([np.inf])
                if (between > d[j]).all():
                    kept.append(j)
            rest = [j for j in near.tolist() if j not in kept]
            kept = (kept + rest + [i] * LINKS)[: self.links.shape[1]]
            self.links[i] = kept
        self.enter = np.unique(np.linspace(0, n - 1, 16).astype(np.int64))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x, the numbers and squared distances of the nearest centroids found, nearest first (-1 and inf beside them)."""
        n, m = len(self.centre), len(x)
        width = min(width, n)
        norm = (x.astype(np.float64) ** 2).sum(axis=1)

        def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            dot = np.einsum("ik,ijk->ij", x[rows], self.centre[to], optimize=True)
            return self.norm[to] + norm[rows, None] - 2 * dot

        seen = np.zeros((m, n), bool)
        enter = np.broadcast_to(self.enter, (m, len(self.enter)))
        seen[:, self.enter] = True
        beam = np.full((m, width), -1, np.int64)
        far = np.full((m, width), np.inf)
        done = np.ones((m, width), bool)

        def merge(rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
            all_ids = np.concatenate((beam[rows], ids), axis=1)
            all_d = np.concatenate((far[rows], d), axis=1)
            all_done = np.concatenate((done[rows], np.isinf(d)), axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            beam[rows] = np.take_along_axis(all_ids, order, 1)
            far[rows] = np.take_along_axis(all_d, order, 1)
            done[rows] = np.take_along_axis(all_done, order, 1)

        every = np.arange(m)
        merge(every, enter, distances(every, enter))
        while len(rows := np.flatnonzero(~done.all(axis=1))):
            next_ = np.argmin(done[rows], axis=1)  # the nearest that wasn't looked at
            at = beam[rows, next_]
            done[rows, next_] = True
            to = self.links[at].astype(np.int64)
            d = distances(rows, to)
            d[np.take_along_axis(seen[rows], to, 1)] = np.inf
            # A link may be listed twice: keep its first place.
            seen[rows[:, None], to] = True
            merge(rows, np.where(np.isinf(d), -1, to), d)
        return beam, np.maximum(far, 0)

    def within(self, x: np.ndarray, ratio: float, most: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and distances of the centroids within the ratio of each row's nearest, nearest first, at most `most` if that is given."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(x)
        rows, width = np.arange(len(x)), BEAM
        while len(rows):
            ids, d = self.search(x[rows], width)
            d = np.sqrt(d)
            n = ((d <= ratio * d[:, :1]) & (ids >= 0)).sum(axis=1)
            enough = (n < ids.shape[1]) | (ids.shape[1] < width) | (width >= len(self.centre)) | (np.full(len(n), most is not None and most < width))
            for i in np.flatnonzero(enough).tolist():
                k = n[i] if most is None else min(most, n[i])
                out[rows[i]] = ids[i, :k], d[i, :k]
            rows, width = rows[~enough], 2 * width
        return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part, whatever their vectors' lengths."""
    v = F.col("embedding").cast("array<double>")
    own = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), v.alias("embedding"))
    return own.where(~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.exists("embedding", lambda x: x != 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest (query, id, score), nearest first, ties to the smaller id; an id counts once."""
    order = np.lexsort((score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[fresh], ids[fresh], score[fresh]
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(query)]))))
    kept = place < k
    return query[kept], ids[kept], score[kept]


def scan(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries (ids asked, vectors x) the k nearest of the rows (ids, y) besides the query's own. Products of matrices find the rows that can
    be among them, with room for rounding; their distances are then taken from the differences."""
    d = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * (x @ y.T)
    d[asked[:, None] == ids[None]] = np.inf
    last = np.full(len(asked), np.inf)
    if len(ids) > k and len(np.unique(ids)) == len(ids):
        last = np.partition(d, k - 1, axis=1)[:, k - 1]
        last = last + 1e-9 * (1 + np.abs(last) + (x**2).sum(axis=1))
    q, r = np.nonzero((d <= last[:, None]) & np.isfinite(d))
    exact = np.sqrt(((y[r] - x[q]) ** 2).sum(axis=1))
    return best(asked[q], ids[r], exact, k)


def _flat(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _groups(t: pa.Table, keys: list[str]) -> list[int]:
    """Where groups of equal keys start, and the end."""
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for c in keys:
        column = t.column(c).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(change).tolist(), t.num_rows]


def _celled(rows: DataFrame, dim: int, which: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(id, cell, nth, v): a row for each row and cell that `which` names for it, nth counting a row's cells from 0."""
    schema = struct_of("id long, cell long, nth int, v array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [ids for ids, _ in which(_flat(part.column(1), dim).astype(np.float32))]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield batch_of({"id": part.column(0).take(row), "cell": np.concatenate(found), "nth": np.concatenate([np.arange(len(f)) for f in found]), "v": part.column(1).take(row)}, schema)

    return rows.mapInArrow(run, schema)


def _leaves(placed: DataFrame, dim: int) -> DataFrame:
    """(cell, leaf, v): the centroids of the lists of each cell, learned from a sample of the vectors at home in it."""
    out = struct_of("cell long, leaf long, v array<double>")
    limit = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    home = placed.where("nth = 0")
    sizes = saved(home.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")  # CELLS rows at most
    sample = home.join(F.broadcast(sizes), "cell").where(F.rand(7) * F.col("n") <= limit).select("cell", "n", "v")
    sample = sample.repartition(shuffle_partitions(placed.sparkSession), "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cell"]):
            cell, n, x = t.column("cell").to_numpy(), t.column("n").to_numpy(), _flat(t.column("v"), dim).astype(np.float32)
            starts = _groups(t, ["cell"])
            for s, e in zip(starts, starts[1:]):
                centre = centroids(x[s:e], max(1, int(n[s]) // LIST) if int(n[s]) > 3 * LIST else 1).astype(np.float64)
                yield batch_of({"cell": np.full(len(centre), cell[s]), "leaf": np.arange(len(centre)), "v": list(centre)}, out)

    return saved(sample.mapInArrow(run, out), "leaves")


def _listed(placed: DataFrame, leaves: DataFrame, dim: int, ratio: float, copies: int | None) -> DataFrame:
    """(id, list, d, v): placed rows (id, cell, nth, v) in the lists of their cells whose distance d is within the ratio of the cell's nearest,
    at most `copies` if that is given, and one only in cells that aren't a row's first. Cells of many rows are cut into pieces, each of
    which meets a copy of the cell's centroids."""
    out = struct_of("id long, list long, d double, v array<double>")
    pieces = saved(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces")), "pieces")  # CELLS rows at most
    base = leaves.join(F.broadcast(pieces), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    base = base.select("cell", "piece", F.lit(0).alias("kind"), F.col("leaf").alias("id"), F.lit(0).alias("nth"), "v")
    rows = placed.join(F.broadcast(pieces), "cell").select("cell", F.pmod(F.monotonically_increasing_id(), F.col("pieces")).alias("piece"), F.lit(1).alias("kind"), "id", "nth", "v")
    group = ["cell", "piece"]
    met = base.unionByName(rows).repartition(shuffle_partitions(placed.sparkSession), *group).sortWithinPartitions(*group, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, group):
            t = t.combine_chunks()
            cell, kind, ids, nth, v = t.column("cell").to_numpy(), t.column("kind").to_numpy(), t.column("id").to_numpy(), t.column("nth").to_numpy(), t.column("v").combine_chunks()
            x = _flat(v, dim)
            starts = _groups(t, group)
            for s, e in zip(starts, starts[1:]):
                mid = s + int(np.searchsorted(kind[s:e], 1))
                if mid == s:
                    continue  # no vector is at home here
                y = x[s:mid]
                for at in range(mid, e, 512):
                    own = x[at : min(e, at + 512)]
                    d = np.sqrt(np.maximum((own**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * own @ y.T, 0))
                    order = np.argsort(d, axis=1, kind="stable")
                    d = np.take_along_axis(d, order, 1)
                    near = d <= ratio * d[:, :1] if np.isfinite(ratio) else np.ones(d.shape, bool)
                    if copies is not None:
                        near &= np.arange(d.shape[1])[None] < np.where(nth[at : at + len(own)] == 0, copies, 1)[:, None]
                    r, c = np.nonzero(near)
                    yield batch_of({"id": ids[at + r], "list": (cell[s] << 32) | ids[s + order[r, c]], "d": d[r, c], "v": v.take(pa.array(at + r))}, out)

    return met.mapInArrow(run, out)


def _pruned(listed: DataFrame, ratio: float) -> DataFrame:
    """Of (id, list, d, v) the rows whose d is within the ratio of their vector's least."""
    hashed = listed.withColumn("h", F.xxhash64("v"))
    least = hashed.groupBy("id", "h").agg(F.min("d").alias("least"))
    return hashed.join(least, ["id", "h"]).where(F.col("d") <= ratio * F.col("least")).select("id", "list", "v")


def _tuned(sample: np.ndarray, graph: Graph, placing: Callable[[DataFrame], DataFrame], leaves: DataFrame, k: int, of: int) -> tuple[float, float, float]:
    """The ratios for copies, for cells and for lists. sample has SAMPLE rows at most, and so have what is collected here: their lists, a few
    each, and these lists' centroids."""
    spark, n = leaves.sparkSession, len(sample)
    listed = placing(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(sample), pa.list_(pa.float64()))}))).select("id", "list", "d").toPandas().sort_values(["id", "d"])
    first = listed.groupby("id")["d"].min()
    listed["ratio"] = listed["d"] / np.maximum(listed["id"].map(first), 1e-300)
    second = listed[listed.groupby("id").cumcount() == 1]["ratio"].to_numpy()
    all_second = np.sort(np.append(second, np.full(n - len(second), np.inf)))
    copy = float(min(COPY_RATIO, max(1.0, all_second[int(SHARE * (n - 1))])))
    listed = listed[listed["ratio"] <= copy]
    used = spark.createDataFrame(pa.table({"list": listed["list"].unique()}))
    there = leaves.withColumn("list", F.col("cell") * (1 << 32) + F.col("leaf")).join(F.broadcast(used), "list").select("list", "v").toArrow()
    number = {x: i for i, x in enumerate(there["list"].to_pylist())}
    centre = _flat(there["v"], sample.shape[1])
    # Vectors that centroids were learned from are nearer to them than others: as large a share of them is asked as the table has.
    apart = min(ASKED, n // 5)
    fresh = max(1, round(apart * (1 - (n - apart) / of)))
    asked = np.append(np.arange(fresh), np.arange(apart, min(n, apart + max(1, apart - fresh))))
    gap = lambda x, y: np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * (x @ y.T), 0))
    d = gap(sample[asked], sample)
    d[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(max(1, round(k * n / of)), max(1, n - 1))]  # of so many rows these are among the k nearest
    own = [[number[x] for x in g] for _, g in listed.groupby("id")["list"]]
    if len(own) < n or n < 2:
        return copy, 1.5, 1.5
    to_list, home = gap(sample[asked], centre), np.maximum(first.to_numpy()[asked], 1e-300)
    cell = np.array([x >> 32 for x in there["list"].to_pylist()])
    to_cell = gap(sample[asked], graph.centre.astype(np.float64))
    lists, cells = [], []
    for q in range(len(asked)):
        for j in near[q].tolist():
            best_list = min(own[j], key=lambda x: to_list[q, x])
            lists.append(to_list[q, best_list] / home[q])
            cells.append(to_cell[q, cell[best_list]] / max(to_cell[q].min(), 1e-300))
    ratio = max(1.0, float(np.quantile(lists, TARGET)))
    in_cells = float(np.quantile([c for c, x in zip(cells, lists) if x <= ratio] or [1.5], IN_CELLS))
    return copy, min(max(1.0, in_cells), 1.08 * ratio), ratio


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What `nearest` returns, and (query_id, lists, scanned): how many lists each query searches and how many rows, copies too, these hold."""
    spark = rows.sparkSession
    schema, told = "query_id long, rank int, vec_id long, score double", "query_id long, lists long, scanned long"
    valid = usable(rows)
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema), spark.createDataFrame([], told)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    valid = valid.where(F.size("embedding") == dim)
    limit = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    # The bound holds for distinct vectors; of one that is repeated, one is taken.
    sample = valid.select("embedding").where(F.pmod(F.xxhash64("embedding"), F.lit(max(1, n // limit))) == 0).distinct().orderBy(F.xxhash64(F.lit(1), "embedding")).limit(limit).toArrow()
    if not sample.num_rows:
        sample = valid.select("embedding").limit(1).toArrow()
    drawn = _flat(sample.column(0), dim)
    learned = drawn[min(ASKED, len(drawn) // 5) :]
    graph = spark.sparkContext.broadcast(Graph(centroids(learned.astype(np.float32), min(CELLS, n // LIST))))

    celled = lambda df: _celled(df, dim, lambda x: graph.value.within(x, COPY_RATIO, COPIES))
    placed = saved(celled(valid), "placed")
    leaves = _leaves(placed, dim)
    copy, cell_ratio, ratio = _tuned(drawn, graph.value, lambda df: _listed(saved(celled(df), "sample"), leaves, dim, COPY_RATIO, COPIES), leaves, k, n)
    posted = saved(_pruned(saved(_listed(placed, leaves, dim, COPY_RATIO, COPIES), "listed"), copy), "postings")
    asked = saved(_celled(usable(queries).where(F.size("embedding") == dim), dim, lambda x: graph.value.within(x, cell_ratio)), "queries")
    asked = saved(_listed(asked, leaves, dim, float("inf"), None), "asked")
    asked = saved(_pruned(asked, ratio), "pruned")

    blocks = saved(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "blocks")
    cuts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CUT).cast("long").alias("cuts"))
    shape = saved(blocks.join(cuts, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"), "cuts"), "shape")
    zero = F.lit(0).cast("long")
    base = posted.join(shape, "list").withColumn("cut", F.explode(F.sequence(zero, F.col("cuts") - 1)))
    base = base.select("list", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).alias("block"), "cut", F.lit(0).alias("kind"), "id", "v")
    to = asked.join(shape, "list").withColumn("cut", F.pmod(F.monotonically_increasing_id(), F.col("cuts"))).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    group = ["list", "block", "cut"]
    met = base.unionByName(to.select(*group, F.lit(1).alias("kind"), "id", "v")).repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "kind")
    out = struct_of("query_id long, vec_id long, score double")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A query's rows from the lists of a task are cut down to its k nearest there, as long as not more than HELD are left.
        found: list[tuple] = []
        size = 0
        for t in whole_groups(batches, group):
            t = t.combine_chunks()
            ids, kind, x = t.column("id").to_numpy(), t.column("kind").to_numpy(), _flat(t.column("v"), dim)
            starts = _groups(t, group)
            for s, e in zip(starts, starts[1:]):
                mid = s + int(np.searchsorted(kind[s:e], 1))
                if s < mid < e:
                    more = [scan(ids[at : min(e, at + 512)], x[at : min(e, at + 512)], ids[s:mid], x[s:mid], k) for at in range(mid, e, 512)]
                    size += sum(len(m[0]) for m in more)
                    found += more
                if size > 2 * HELD:
                    found = [best(*(np.concatenate(parts) for parts in zip(*found)), k)]
                    size = len(found[0][0])
                    if size > HELD:
                        yield batch_of(dict(zip(out.fieldNames(), found[0])), out)
                        found, size = [], 0
        if found:
            yield batch_of(dict(zip(out.fieldNames(), best(*(np.concatenate(parts) for parts in zip(*found)), k))), out)

    merged = met.mapInArrow(meet, out).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    result = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return result, asked.join(blocks, "list").groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("scanned"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows, queries (vec_id, embedding). Returns (query_id, rank, vec_id, score): of each query the k nearest rows found besides the row
    with its own vec_id; score is the distance.

    Shuffled are the vectors, once for each cell and list that they are in (COPIES cells and COPIES lists at most), and the queries, once
    for each list they search. What is sent to all executors (the cells' centroids and graph) and to the driver (the sample) has a
    size set by SAMPLE, SAMPLE_BYTES and CELLS; centroids of lists are a table.
    """
    return search(rows, queries, k)[0]
