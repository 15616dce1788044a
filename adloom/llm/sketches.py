"""N-gram Jaccard join by parity sketches.

Method. A set of shingles is hashed into bits, each shingle flipping one: the parity sketch. Two sketches differ in no more bits than
their sets in members, so their Hamming distance bounds the symmetric difference from below. Sizes are cut into bands. Of two sets
with a similarity of p or more, the smaller of them in a band, no more than a known number d of members are in one only; each
set of the band (and of the next band, as far as its sizes can link) is cut by hashes into d + 1 parts, and as d members can't be in all of
them, the parity sketches of some part are equal. Part and sketch are the key under which sets meet. Those that meet are compared by
size and by a sketch of the whole set, what may be a link by a sketch of a bit or two a member, as the first has too few bits for long
texts, and what that doesn't refute is verified on both whole sets.

Sets that are equal are one class. Of a bucket not all pairs are verified: a spanning forest of the pairs that may be links is, enough to
connect what they connect. Then the verified links make components, and the buckets are looked at again, only for pairs of
different components that weren't refuted; that ends when there are none, so components are exact and no link between them is lost. In each
further round a row brings more of its pairs, in case many are refuted. Buckets over PIECE rows are cut into pieces: two rounds look
within pieces only, cut in two ways, which makes most of what is alike one component; the others look at all pieces against each
other, save those of one component. So a bucket of any size is spread over tasks.

Null and blank texts have no shingles and link with nothing, not even with each other. Rows without doc_id link nothing and have a null
component. Rows that repeat a doc_id go each by their own set; repeated rows are in one class. Texts are taken whole; columns besides doc_id and text are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import HOT, batch_of, drop, join_counted, saved, shuffle_partitions, struct_of, task_of, whole_groups
from adloom.llm.components import components

#: Words of a shingle; the least similarity of a link, in percent.
SHINGLE, PERCENT = 3, 90
#: Sizes in a band differ by less than this factor.
BAND = 1.5
#: Rows of a bucket that are compared together; a tile holds one piece or two.
PIECE = 1024
#: Rows that are broadcast; more are joined by a shuffle.
FEW = 500_000
#: One class of so many is in the sample that tells hot keys.
SAMPLE = 64
#: Bits of the sketch of a whole set, in words of 64.
WORDS = 4
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its shingles, ascending; of fewer words the hash of all, of none nothing. Only A-Z are lower-cased."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(real))[offsets - offsets[0]]
    coded = words.filter(pa.array(real)).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    h = distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for j in range(shingle):
        whole = mixed(whole + h[j : j + len(whole)] + np.uint64(j + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(whole[a : b - shingle + 1])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for j in range(b - a):
                one = mixed(one + h[a + j : a + j + 1] + np.uint64(j + 1))
            yield one
        else:
            yield np.zeros(0, np.uint64)


def parity(places: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places are hit an odd number of times."""
    return (np.bincount(places, minlength=size) & 1).astype(bool)


def sketch(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Words of 64 bits: each hash of the set flips one bit. Sketches differ in no more bits than the sets in members."""
    bits = 64 * words
    return np.packbits(parity((mixed(own + np.uint64(ODD[0])) % np.uint64(bits)).astype(np.int64), bits), bitorder="little").view(np.uint64)


def long_sketch(own: np.ndarray) -> np.ndarray:
    """The same with a bit for each member at least, less than two, or one word; words are a power of two, so that of two lengths the longer can be folded."""
    return sketch(own, max(1, (1 << (len(own) - 1).bit_length()) // 64))


def edges(percent: int, most: int) -> list[int]:
    """Where bands of sizes begin, up to most. The first begins at the least size that can link with another set."""
    out = [1]
    while out[-1] * (100 - percent) // percent < 1:
        out[-1] += 1
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def schemes(n: int, percent: int, bands: list[int]) -> list[tuple[int, int]]:
    """The bands whose joins a set of size n takes part in, with the number of parts: one more than the members in which two sets that link, the
    smaller of that band, can differ."""
    k = int(np.searchsorted(bands, n, "right")) - 1
    both = [k - 1, k] if k > 0 and 100 * (bands[k] - 1) >= percent * n else [k]
    return [(j, (bands[j + 1] - 1) * (100 - percent) // percent + 1) for j in both if j >= 0]


def signatures(own: np.ndarray, percent: int, bands: list[int]) -> np.ndarray:
    """A key for each part of the set in each scheme, from the part's parity sketch: its bits are as many as hashes, of which each flips one; the
    key is the exclusive or of the set bits' numbers."""
    keys = []
    for band, parts in schemes(len(own), percent, bands):
        salt = np.uint64(ODD[1] * (band + 1) % (1 << 64))
        part = (mixed(own ^ salt) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[order], np.arange(parts))
        value = np.append(mixed(own + np.uint64(ODD[2]))[order], np.uint64(0))
        x = np.bitwise_xor.reduceat(value, begin)
        x[begin == np.append(begin[1:], len(own))] = 0
        keys.append(mixed(mixed(x + salt) + np.arange(parts, dtype=np.uint64)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def digest(own: np.ndarray) -> bytes:
    """128 bits of a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


SKETCH = [f"s{i}" for i in range(WORDS)]


def prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(row, doc_id, h1, h2, n, s0 ..., keys): of each row a number, the digest and the size of its set, its sketch and the keys under which it meets others."""
    out = struct_of("doc_id long, h1 long, h2 long, n long, " + ", ".join(f"{s} long" for s in SKETCH) + ", keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("sketches")
        bands = edges(percent, 1 << 40)
        for b in batches:
            sizes, digests, whole, keys = [], [], np.zeros((b.num_rows, WORDS), np.uint64), []
            for i, own in enumerate(sets(b.column(1), shingle)):
                sizes.append(len(own))
                digests.append(digest(own))
                whole[i] = sketch(own)
                keys.append(signatures(own, percent, bands).view(np.int64))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield batch_of({"doc_id": b.column(0), "h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "n": sizes, "keys": keys} | {s: whole[:, i].copy().view(np.int64) for i, s in enumerate(SKETCH)}, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id())


def members(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (text). Returns (h1, h2, hashes array<long>, bits array<long>) of each row: the set and its long sketch."""
    out = struct_of("h1 long, h2 long, hashes array<long>, bits array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(sets(b.column(0), shingle))
            h = np.frombuffer(b"".join(map(digest, own)), np.int64).reshape(-1, 2)
            yield batch_of({"h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "hashes": [x.view(np.int64) for x in own], "bits": [long_sketch(x).view(np.int64) for x in own]}, out)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, out)


def may_link(n: np.ndarray, s: np.ndarray, m: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with sketches s and t can have that similarity."""
    apart = np.bitwise_count(s ^ t).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def pairs_of(node: np.ndarray, label: np.ndarray, n: np.ndarray, s: np.ndarray, piece: np.ndarray, refuted: pa.Array, percent: int, more: int) -> list[tuple[int, int]]:
    """Rows of a tile that may link and are of different labels: a spanning forest, and of each row the first `more`. piece: where a tile
    holds two pieces, only pairs across them count."""
    size, two = len(node), piece.min() != piece.max()
    # Rows are in the order of their nodes; refuted has lists of nodes.
    again = np.ones((size, size), bool) if refuted.null_count < size else None
    if again is not None:
        length = np.nan_to_num(pc.list_value_length(refuted).to_numpy(zero_copy_only=False)).astype(np.int64)
        others = refuted.flatten().to_numpy()
        to = np.minimum(np.searchsorted(node, others), size - 1)
        here = node[to] == others
        row = np.repeat(np.arange(size), length)[here]
        again[row, to[here]] = again[to[here], row] = False
    left, found = np.ones(size, bool), []
    for first in range(size):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            i = front.pop()
            near = may_link(n[i], s[i], n, s, percent) & (label != label[i])
            if two:
                near &= piece != piece[i]
            if again is not None:
                near &= again[i]
            if more:
                found += [(i, i + 1 + j) for j in np.flatnonzero(near[i + 1 :])[:more].tolist()]
            fresh = np.flatnonzero(near & left).tolist()
            left[fresh] = False
            found += [(i, j) for j in fresh]
            front += fresh
    return found


def tiles(rows: DataFrame, across: bool, seed: int) -> DataFrame:
    """rows (key, node, label, ...). Returns them with lo, hi and piece: rows of one (key, lo, hi) are compared. Keys of one label go. across: pieces of
    large buckets also meet each other, but for two of one label."""
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    large = F.col("c") > PIECE // 2
    own = F.struct("label", F.ceil(F.col("c") / PIECE).cast("int").alias("pieces"))
    keys = labels.groupBy("key").agg(F.sum("c").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"), F.collect_list(F.when(large, own)).alias("large"), F.coalesce(F.sum(F.when(~large, F.col("c"))), F.lit(0)).alias("small"))
    # A label that is listed has over PIECE / 2 rows of the bucket, so the list is short beside it.
    keys = saved(keys.where("a < b").select("key", "n", F.col("n").alias("rows"), "small", F.when(F.col("n") > PIECE, F.col("large")).otherwise(F.array().cast(keys.schema["large"].dataType)).alias("large")), "tiles")
    rows = _joined(rows, keys, ["key"], rows)
    pools = F.ceil(F.when(F.size("large") > 0, F.col("small")).otherwise(F.col("rows")) / PIECE).cast("int")
    code = lambda label, sub: F.xxhash64(label, sub.cast("long"))
    none = F.lit(None).cast("long")
    mine = F.get(F.filter("large", lambda x: x["label"] == F.col("label")), 0)
    rows = rows.withColumn("pools", pools).withColumn("own", mine)
    spread = F.xxhash64("node", F.lit(seed))
    piece = F.when(F.col("own").isNull(), code(none, F.pmod(spread, F.greatest("pools", F.lit(1))))).otherwise(code(F.col("label"), F.pmod(spread, F.col("own.pieces"))))
    rows = rows.withColumn("piece", piece)
    if across:
        numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        others = F.filter("large", lambda x: F.col("own").isNull() | (x["label"] != F.col("label")))
        partners = F.concat(F.transform(numbers(F.col("pools")), lambda q: code(none, q)), F.flatten(F.transform(others, lambda x: F.transform(numbers(x["pieces"]), lambda q: code(x["label"], q)))))
        rows = rows.withColumn("partner", F.explode(partners))
    else:
        rows = rows.withColumn("partner", F.col("piece"))
    return rows.withColumn("lo", F.least("piece", "partner")).withColumn("hi", F.greatest("piece", "partner"))


def candidates(rows: DataFrame, percent: int, more: int) -> DataFrame:
    """rows (key, lo, hi, piece, node, label, n, s0 ..., refuted). Returns (key, u, v), u < v: pairs to verify, and the buckets that they are from."""
    group, out = ["key", "lo", "hi"], struct_of("key long, u long, v long")
    rows = rows.select(*group, "piece", "node", "label", "n", *SKETCH, "refuted")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *group).sortWithinPartitions(*group, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("sketches")
        for t in whole_groups(batches, group):
            cols = {c: t.column(c).to_numpy() for c in t.column_names if c != "refuted"}
            lists = t.column("refuted")
            s = np.stack([cols[c] for c in SKETCH], axis=1).view(np.uint64)
            change = np.ones(t.num_rows + 1, bool)
            change[1:-1] = False
            for c in group:
                change[1:-1] |= cols[c][1:] != cols[c][:-1]
            begin = np.flatnonzero(change)
            size, begin = np.diff(begin), begin[:-1]
            a = begin[size == 2]  # most buckets
            near = may_link(cols["n"][a], s[a], cols["n"][a + 1], s[a + 1], percent) & (cols["label"][a] != cols["label"][a + 1]) & ((cols["lo"][a] == cols["hi"][a]) | (cols["piece"][a] != cols["piece"][a + 1]))
            a = a[near]
            some = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            refuted = np.flatnonzero(np.nan_to_num(some[a]) + np.nan_to_num(some[a + 1]) > 0)
            wrong = [k for k in refuted.tolist() if cols["node"][a[k]] in (lists[int(a[k]) + 1].as_py() or ()) or cols["node"][a[k] + 1] in (lists[int(a[k])].as_py() or ())]
            a = np.delete(a, wrong)
            u, v, key = [cols["node"][a]], [cols["node"][a + 1]], [cols["key"][a]]
            for i, k in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                part = slice(i, i + k)
                found = pairs_of(cols["node"][part], cols["label"][part], cols["n"][part], s[part], cols["piece"][part], lists.slice(i, k).combine_chunks(), percent, more)
                if found:
                    x, y = cols["node"][part][np.array(found)].T
                    u.append(np.minimum(x, y))
                    v.append(np.maximum(x, y))
                    key.append(np.full(len(x), cols["key"][i]))
            u, v, key = np.concatenate(u), np.concatenate(v), np.concatenate(key)
            if len(u):
                yield batch_of({"key": key, "u": u, "v": v}, out)

    return rows.mapInArrow(run, out)


def firsts(found: DataFrame, classes: DataFrame) -> DataFrame:
    """found (row, keys, ...), classes (node): node is the first row of its class. Returns (node, keys), the keys once a class. A bit a row tells the first
    ones, and 64 of them are a row of the table that is joined, so it is sent to the keys and these aren't shuffled, up to 64 * FEW rows at least."""
    words = classes.groupBy(F.shiftright("node", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("first"))
    met = found.withColumn("word", F.shiftright("row", 6)).join(_few(saved(words, "firsts")), "word")
    return met.where(F.getbit("first", F.col("row").bitwiseAND(63).cast("int")) == 1).select(F.col("row").alias("node"), "keys")


def meetings(classes: DataFrame) -> DataFrame:
    """classes (node, keys). Returns (key, node): what is under a key that two or more are under. All keys are shuffled once, whatever their number.
    Keys that a sample shows to be hot are broadcast, fewer than HOT, and their rows stay where they are; that two rows of the sample have one is
    enough to know that it is kept."""
    met = classes.select("node", F.explode("keys").alias("key"))
    part = F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0
    rows = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = classes.where(part).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = saved(hot.where((F.col("n") >= 4) & (F.col("n") * SAMPLE * HOT > rows)).orderBy(F.desc("n")).limit(HOT).select("key"), "hot")
    own = met.join(F.broadcast(hot), "key", "left_semi").select("key", "node")
    rest = met.join(F.broadcast(hot), "key", "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return own.unionByName(rest.where("n > 1").select("key", "node"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _joined(big: DataFrame, small: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """big with small (keys, n, ...), in which each key is once and n counts its rows in `rows`: by a broadcast if small is short."""
    return big.join(F.broadcast(small.drop("n")), keys) if small.count() <= FEW else join_counted(big, small, keys, rows.count())


def _folded(bits: str, words: Column) -> Column:
    """A sketch with so many words, of one with as many or twice as many."""
    return F.when(F.size(bits) > words, F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))


def sifted(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v), own (node, n, bits). Returns (u, v, may): whether long sketches leave open that the sets have that similarity. Sizes of a pair are
    within `percent` of each other, so its sketches have as many words or twice as many."""
    right = own.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b")).join(_few(pairs), "v")
    both = right.join(own.select(F.col("node").alias("u"), "n", F.col("bits").alias("a")), "u")
    words = F.least(F.size("a"), F.size("b"))
    apart = F.aggregate(F.zip_with(_folded("a", words), _folded("b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return both.select("u", "v", ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))).alias("may")).distinct()


def verified(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v), own (node, n, hashes, bits). Returns (u, v, link): whether the whole sets have that similarity. Long sketches, some fiftieth of the sets'
    bytes, refute most of those that haven't. A forest hangs many v on one u, so each v brings its set to u. It gets its pairs where it is, if these are few."""
    seen = saved(sifted(pairs, own, percent), "sifted")
    pairs = seen.where("may").select("u", "v")
    right = own.select(F.col("node").alias("v"), F.col("hashes").alias("b")).join(_few(pairs), "v")
    left = own.join(_few(pairs.select(F.col("u").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    both = right.join(left, "u").select("u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.size("a") + F.size("b")).cast("long").alias("total"))
    whole = both.select("u", "v", (F.col("shared") * 100 >= percent * (F.col("total") - F.col("shared"))).alias("link")).distinct()
    return whole.unionByName(seen.where("not may").select("u", "v", F.lit(False).alias("link")))


def join(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, n_shingles, component_id): component_id is the least doc_id that can be reached over links; two rows link
    if their sets of shingles have a Jaccard similarity of `percent` or more."""
    keyed = saved(prints(docs, shingle, percent), "prints")
    found = saved(keyed.drop("keys"), "found")
    classes = found.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("row").alias("node"), *(F.first(c).alias(c) for c in ("n", *SKETCH)))
    classes = saved(classes.where("rep is not null"), "classes")
    # Keys are most of what is written; what meets is little, and nothing else needs them.
    buckets = saved(meetings(firsts(keyed, classes)), "buckets")
    drop(keyed)
    ends = saved(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "rep", "h1", "h2", "n", *SKETCH), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(_few(ends.select("rep").distinct()), "rep", "left_semi")
    own = saved(members(texts, shingle).join(_few(ends.select("h1", "h2", "node", "n")), ["h1", "h2"]).select("node", "n", "hashes", "bits"), "members")
    hot = buckets.groupBy("key").count().where(F.col("count") > PIECE).limit(1).count() > 0

    links, refuted, roots, turn = None, None, None, 0
    while True:
        across = turn > 1 or not hot
        rows = buckets
        if roots is not None:
            rows = rows.join(_few(roots.withColumnRenamed("root", "label")), "node", "left")
            rows = rows.withColumn("label", F.coalesce("label", "node"))
        else:
            rows = rows.withColumn("label", F.col("node"))
        rows = tiles(rows.select("key", "node", "label"), across, turn).join(_few(ends.select("node", F.col("n").alias("size"), *SKETCH)), "node")
        rows = rows.withColumnRenamed("size", "n")
        if refuted is None:
            rows = rows.withColumn("refuted", F.lit(None).cast("array<long>"))
        else:
            rows = rows.join(_few(refuted.groupBy(F.col("v").alias("node")).agg(F.collect_list("u").alias("refuted"))), "node", "left")
        found_pairs = saved(candidates(rows, percent, 2 ** (turn + 1) if turn else 0), "pairs")
        pairs = saved(found_pairs.select("u", "v").distinct(), "distinct")
        n = pairs.count()
        turn += 1
        if not n and across:
            break
        if across:  # a bucket without such pairs won't have any later
            buckets = saved(buckets.join(_few(found_pairs.select("key").distinct()), "key", "left_semi"), "buckets")
        if not n:
            continue
        checked = saved(verified(pairs, own, percent), "checked")
        links = checked.where("link") if links is None else links.unionByName(checked.where("link"))
        refuted = checked.where("not link") if refuted is None else refuted.unionByName(checked.where("not link"))
        roots = saved(components(links.select("u", "v")), "roots")

    to = classes.select("h1", "h2", F.col("rows").alias("n"), "rep", "node")
    if roots is None:
        to = to.select("h1", "h2", "n", F.col("rep").alias("component_id"))
    else:
        linked = saved(to.join(roots, "node").select("node", "root", "rep"), "linked")
        least = linked.groupBy("root").agg(F.min("rep").alias("least"))
        to = to.join(linked.join(least, "root").select("node", "least"), "node", "left").select("h1", "h2", "n", F.coalesce("least", "rep").alias("component_id"))
    to = saved(to, "components")
    some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", some.alias("some"))
    merged = join_counted(rows.where("some"), to, ["h1", "h2"], found.count()).select("doc_id", "n_shingles", "component_id")
    return merged.unionByName(rows.where("not some").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
