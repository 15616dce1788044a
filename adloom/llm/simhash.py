"""SimHash near-duplicates found through pivot distance tables.

Method. Every distinct fingerprint gets a row of Hamming distances to many fixed reference fingerprints (the pivots). By the
triangle inequality two fingerprints that differ in at most r bits have pivot distances that differ by at most r in every
coordinate, so a pair with a larger coordinate difference is discarded without looking at it; the survivors are verified bit by
bit. Fingerprints are compared within tiles: the 64 bits are cut into blocks, and two fingerprints that differ in at most r
bits agree on all but r blocks, so each choice of the other blocks is one bucket key. Within a tile, rows are sorted by the first
pivot distance and a window of width r slides over them; the other coordinates are then compared, then the bits. A bucket of
any size is cut into tiles of bounded size, each pair of pieces one tile, so a hot bucket is spread over tasks; a tile gives
a star for each group that it finds, never its pairs.

Null, empty or blank texts have the fingerprint zero and are linked like any other. Rows without doc_id get a fingerprint, link
nothing and have a null component. Rows that repeat a doc_id each go by their own fingerprint. Columns besides doc_id and text
are ignored.

keep_one, the pipeline's stage, has five-word shingles and a similarity of 0.8 or more, for which 64 bits and a small radius are too
short. Its prints have 256 bits; tables keyed by sampled bits bring prints together; of each bucket the minimum spanning forest of near
prints gives the links, and each link is verified by its texts' whole sets of shingles. Texts of equal lower-cased words are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, join_counted, saved, shuffle_partitions, struct_of, task_of, whole_groups
from adloom.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Reference fingerprints, fixed: hashes of their numbers.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(16)]
#: Rows of one piece of a bucket; a tile holds two pieces.
PIECE = 512
#: Rows that a bucket should hold on average, which decides the number of blocks.
BUCKET = 256


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text: of the bits of all shingles' hashes, those that are set in over half."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 15):
        h = np.array([digest(joined[s:e], seed) for s, e in spans[at : at + (1 << 15)]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a row for each row of docs; fp is the fingerprint as a signed long."""
    out = struct_of("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield batch_of({"doc_id": b.column(0), "fp": fp.view(np.int64)}, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def hex_of(fp: str = "fp"):
    """The 16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def masks(n: int, radius: int) -> list[int]:
    """The bit masks of the bucket keys for n fingerprints: any two within the radius agree under at least one of them."""
    for blocks in range(radius + 1, 2 * radius + 1):
        bits = 64 * (blocks - radius) // blocks
        if n <= BUCKET << bits:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _join(parent: list[int], a: int, b: int) -> bool:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def stars(tile: np.ndarray, piece: np.ndarray, cross: np.ndarray, table: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within tiles, as stars. tile: numbers of the rows' tiles, ascending, within them the first column of `table` (the
    pivot distances) ascending; cross: the tile pairs two different pieces, so only pairs across them count."""
    n = len(fp)
    parent, label = list(range(n)), np.arange(n)
    at, k = np.arange(n), 1
    first = table[:, 0].astype(np.int16)
    bits = fp.view(np.uint64)
    while True:
        at = at[at + k < n]
        at = at[(tile[at] == tile[at + k]) & (first[at + k] - first[at] <= radius)]  # both fail for good once they fail
        if not len(at):
            break
        a, b = at, at + k
        fresh = (label[a] != label[b]) & ~(cross[a] & (piece[a] == piece[b]))
        a, b = a[fresh], b[fresh]
        for p in range(1, table.shape[1]):  # largest coordinate difference
            if not len(a):
                break
            near = np.abs(table[a, p].astype(np.int16) - table[b, p]) <= radius
            a, b = a[near], b[near]
        if len(a):
            near = _distance(bits[a], bits[b]) <= radius
            joined = [_join(parent, x, y) for x, y in zip(a[near].tolist(), b[near].tolist())]
            if any(joined):
                label = np.array(parent)
                while (label[label] != label).any():
                    label = label[label]
                parent = label.tolist()
        k += 1
    leaf = np.flatnonzero(label != np.arange(n))
    return fp[leaf], fp[label[leaf]]


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """classes (fp long, distinct). Returns (u, v): links between fingerprints that differ in at most radius bits, enough of them to
    connect all that are connected."""
    spark = classes.sparkSession
    out = struct_of("u long, v long")
    keys = [_signed(m) for m in masks(classes.count(), radius)]
    table = [f"p{i:02d}" for i in range(len(PIVOTS))]
    rows = classes.select("fp", *(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte").alias(c) for p, c in zip(PIVOTS, table)))
    rows = rows.select("*", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(keys)))).alias("b")).select("fp", *table, "b.t", "b.key")
    big = saved(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE), "buckets")
    rows = rows.join(big, ["t", "key"], "left").withColumn("pieces", F.coalesce(F.ceil(F.col("n") / PIECE), F.lit(1)).cast("int"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("long"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("fp", *table, "t", "key", "piece", F.least("piece", "j").alias("lo"), F.greatest("piece", "j").cast("long").alias("hi"))
    group = ["t", "key", "lo", "hi"]
    rows = rows.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, table[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, group):
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            change = np.zeros(t.num_rows, bool)
            for c in group:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            u, v = stars(np.cumsum(change), cols["piece"], cols["lo"] != cols["hi"], np.stack([cols[c] for c in table], axis=1), cols["fp"], radius)
            if len(u):
                yield batch_of({"u": u, "v": v}, out)

    return rows.mapInArrow(run, out)


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, fp, component_id): component_id is the least doc_id that can be reached over links between
    fingerprints at radius or fewer differing bits, the row's own included."""
    prints = saved(fingerprints(docs, shingle, seed), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes.where("rep is not null"), "classes")
    roots = saved(components(links(classes.select("fp"), radius)), "roots")
    linked = saved(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "rep"), "linked")
    least = saved(linked.groupBy("root").agg(F.min("rep").alias("least")), "least")
    merged = linked.join(least, "root").select("fp", "least")
    to = saved(classes.join(merged, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")), "components")
    found = join_counted(prints.where("doc_id is not null"), to, ["fp"], prints.count()).select("doc_id", "fp", "component_id")
    return found.unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


#: For keep_one: words of a shingle, bits of the long print, and how far apart prints of similar texts may be. Of a pair with similarity
#: 0.8 each bit differs with probability 0.15, so 39 of 256 bits with a deviation of 6.
SHINGLE, WORDS, FAR = 5, 4, 58
#: A bit of such a pair agrees with this probability; the share of such pairs that some table must bring together.
AGREE, CAUGHT = 0.8485, 0.995
#: Rows that a bucket of long prints should hold on average, and rows of a piece of it.
CROWD, LONG_PIECE = 128, 2048


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of `shingle` words, of all words if there are fewer; ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = _mixed(out + h[j : len(words) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(out)


def long_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, in WORDS words of 64 bits."""
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        for w in range(WORDS):
            bits = np.unpackbits(_mixed(hashes[at : at + (1 << 15)] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _lower_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def long_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, w0, ...): of each row with doc_id a 128-bit hash of its lower-cased words, how many shingles they have, the print."""
    names = [f"w{i}" for i in range(WORDS)]
    out = struct_of("doc_id long, h1 long, h2 long, n long, " + ", ".join(f"{w} long" for w in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("simhash")
        for b in batches:
            digests, sizes, prints = [], [], np.zeros((b.num_rows, WORDS), np.uint64)
            for i, x in enumerate(b.column(1)):
                words = _lower_words(x.as_py())
                digests.append(xxhash.xxh3_128_digest(" ".join(words)))
                own = shingles(words)
                sizes.append(len(own))
                prints[i] = long_print(own)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield batch_of({"doc_id": b.column(0), "h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "n": sizes} | {w: prints[:, i].copy().view(np.int64) for i, w in enumerate(names)}, out)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def samples(n: int, seed: int = 7) -> np.ndarray:
    """The bits of a print that make each table's bucket key: a row of numbers for each table. More prints take more bits, so that
    buckets stay small, and then more tables, so that a similar pair still meets in one."""
    k = max(4, int(np.ceil(np.log2(max(n, 1) / CROWD + 1))))
    tables = int(np.ceil(np.log(1 - CAUGHT) / np.log1p(-(AGREE**k))))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(64 * WORDS, k, replace=False) for _ in range(tables)])


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs of prints within the radius. Whatever bound the links are held to after that, what is
    connected by pairs within it is connected by links of the forest within it."""
    n, near = len(prints), []
    for at in range(0, n, 256):
        d = np.zeros((min(256, n - at), n), np.uint16)
        for w in range(prints.shape[1]):
            d += np.bitwise_count(prints[at : at + 256, None, w] ^ prints[None, :, w])
        near.append((d <= radius).sum(axis=1) > 1)
    rows = np.flatnonzero(np.concatenate(near))
    if not len(rows):
        return []
    own = prints[rows]
    best, source, links = np.full(len(rows), 1 << 14, np.int64), np.zeros(len(rows), np.int64), []
    done, at = np.zeros(len(rows), bool), 0
    for _ in range(len(rows) - 1):
        done[at] = True
        d = np.bitwise_count(own ^ own[at]).sum(axis=1, dtype=np.int64)
        closer = (d < best) & ~done
        best[closer], source[closer] = d[closer], at
        best[at] = 1 << 15
        at = int(np.argmin(best))
        if best[at] <= radius:
            links.append((int(rows[source[at]]), int(rows[at])))
    return links


def candidates(classes: DataFrame) -> DataFrame:
    """classes (node, w0, ...). Returns (u, v): distinct pairs of nodes whose prints are within FAR, of each bucket a spanning forest."""
    spark = classes.sparkSession
    names = [f"w{i}" for i in range(WORDS)]
    bits = samples(classes.count())
    weights = (1 << np.arange(bits.shape[1])).astype(np.int64)
    rows_out, key_out, out = struct_of("key long, node long, " + ", ".join(f"{w} long" for w in names)), struct_of("key long"), struct_of("u long, v long")

    def keys(b: pa.RecordBatch) -> np.ndarray:
        prints = np.ascontiguousarray(np.stack([b.column(1 + i).to_numpy() for i in range(WORDS)], axis=1))
        on = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
        return np.stack([on[:, own] @ weights + (t << 40) for t, own in enumerate(bits)], axis=1)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of({"key": keys(b).ravel()}, key_out)

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                k = keys(part)
                yield batch_of({"key": k.ravel()} | {c: np.repeat(part.column(i).to_numpy(), k.shape[1]) for i, c in enumerate(["node", *names])}, rows_out)

    own = classes.select("node", *names)
    big = saved(own.mapInArrow(only_keys, key_out).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LONG_PIECE), "crowds")
    rows = own.mapInArrow(with_keys, rows_out).join(big, "key", "left")
    rows = rows.withColumn("pieces", F.coalesce(F.ceil(F.col("m") / LONG_PIECE), F.lit(1)).cast("int"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("long"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("key", F.least("piece", "j").alias("lo"), F.greatest("piece", "j").cast("long").alias("hi"), "node", *names)
    group = ["key", "lo", "hi"]
    rows = rows.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, group):
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            change = np.ones(t.num_rows + 1, bool)
            change[1:-1] = False
            for c in group:
                change[1:-1] |= cols[c][1:] != cols[c][:-1]
            edges = np.flatnonzero(change)
            wide = np.flatnonzero(np.diff(edges) > 1)
            prints = np.stack([cols[w] for w in names], axis=1).view(np.uint64)
            found = [(s + a, s + b) for s, e in zip(edges[wide].tolist(), edges[wide + 1].tolist()) for a, b in forest(prints[s:e], FAR)]
            if found:
                at = np.array(found)
                u, v = cols["node"][at[:, 0]], cols["node"][at[:, 1]]
                yield batch_of({"u": np.minimum(u, v), "v": np.maximum(u, v)}, out)

    return rows.mapInArrow(run, out).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs (text). Returns (h1, h2, hashes array<long>) of each row: the hash of its words and the hashes of its shingles."""
    out = struct_of("h1 long, h2 long, hashes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sets = [], []
            for x in b.column(0):
                words = _lower_words(x.as_py())
                digests.append(xxhash.xxh3_128_digest(" ".join(words)))
                sets.append(shingles(words).view(np.int64))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield batch_of({"h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "hashes": sets}, out)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, out)


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, component_id) of each row with doc_id: the least doc_id that can be reached over texts of equal
    lower-cased words and over links whose sets of five-word shingles, compared whole, have a Jaccard similarity of `percent` or more."""
    prints = saved(long_prints(docs), "prints")
    words = [f"w{i}" for i in range(WORDS)]
    classes = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("shingles"), F.count(F.lit(1)).alias("n"), *(F.first(w).alias(w) for w in words))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = saved(candidates(classes.where("shingles > 0")), "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    ends = saved(classes.join(ends, "node", "left_semi").select("node", "rep", "h1", "h2"), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ends.select("rep").distinct(), "rep", "left_semi")
    sets = saved(shingle_sets(texts).join(ends, ["h1", "h2"]).dropDuplicates(["node"]).select("node", "hashes"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("shared"), (F.size("a") + F.size("b")).alias("total"))
    links = saved(both.where(F.col("shared") * 100 >= percent * (F.col("total") - F.col("shared"))).select("u", "v"), "verified")
    roots = saved(components(links), "roots")
    linked = saved(classes.join(roots, "node").select("node", "root", "rep"), "linked")
    least = saved(linked.groupBy("root").agg(F.min("rep").alias("least")), "least")
    merged = linked.join(least, "root").select("node", "least")
    to = saved(classes.join(merged, "node", "left").select("h1", "h2", "n", F.coalesce("least", "rep").alias("component_id")), "components")
    return join_counted(prints, to, ["h1", "h2"], prints.count()).select("doc_id", "component_id")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component of `similar` the row of its least doc_id stays, as do all rows without doc_id. Where rows
    repeat that id, one of them stays, the one with the least hash of all its columns. Null, empty and blank texts are one class. All
    columns of docs stay, texts aren't shuffled for repeated ids unless there are any, and no rows give no rows."""
    kept = similar(docs, percent).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rest = rows.where("id is not null").join(kept, "id", "left_semi")
    nameless = rows.where("id is null").select("row.*")
    repeated = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).count().where("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return rest.select("row.*").unionByName(nameless)
    one = rest.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.join(repeated, "id", "left_anti").select("row.*").unionByName(one.select("row.*")).unionByName(nameless)
