"""Periodic runs, the n-gram Jaccard join and ranked lexical search against plain Python and their SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import common, lexical, neighbours, oracle, packing, queries, repeats, sketches, substrings, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A = "The cat sat on the mat and looked at the moon for a long time. It was a quiet night in the village."
EDGE = [(1, A, "en", "s", 1), (2, None, None, "s", 0), (3, "", "en", None, 0), (4, A, "en", "s", 1), (4, A, "en", "s", 1), (None, A, "en", "s", 1), (5, "12 34 !!", "en", "s", 8), (6, "word " * 30_000, "en", "s", 150_000), (7, "été 中文\x0b\U0001f600 x", "fr", "s", 8), (8, " \t\n", "en", "s", 3)]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with nulls, an empty, a blank and a very long text, ties, repeated rows and columns whose names operators also use."""
    names = ("runs", "component_id", "row", "node", "score", "rank", "term")
    return spark.createDataFrame(EDGE, DOCS).select("*", *(F.lit(1).alias(n) for n in names)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_runs", "op12_jaccard", "op13_nra"])
def test_query_is_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(x)] for x in columns) for r in found.fetchall()), key=str)
    assert rows_of(df, columns) == want


# --- runs ---
def plain_runs(words, least, times):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def looping(rng):
    kinds = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(kinds) for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(3)):
        if len(words) > 30:
            a, p = rng.randrange(len(words)), rng.randrange(1, 30)
            for i in range(a + p, min(len(words), a + rng.randrange(1, 150))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (10, 2), (1, 2), (40, 5)])
def test_runs_are_all_maximal_repetitions(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [looping(rng) for _ in range(rng.randrange(1, 6))]
        codes = np.array([x for w in texts for x in [*(v + 1 for v in w), 0]], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) + 1 for w in texts])
        base = np.cumsum([0] + [len(w) + 1 for w in texts])
        got = [[] for _ in texts]
        for s, e, q in zip(*(x.tolist() for x in repeats.runs(codes, text, least, times))):
            got[text[s]].append((s - int(base[text[s]]), q, e - s))
        assert got == [plain_runs(w, least, times) for w in texts]


def test_fibonacci_words_and_one_word_over_and_over():
    a, b = [1], [1, 2]
    while len(b) < 2000:
        a, b = b, b + a
    for words in (b[:2000], [1] * 3000):
        codes = np.array([*words, 0], np.int64)
        got = list(zip(*(x.tolist() for x in repeats.runs(codes, np.zeros(len(codes), np.int64), 24, 3))))
        assert [(s, q, e - s) for s, e, q in got] == plain_runs(words, 24, 3)


def test_collapse_on_edges(spark, edge, empty):
    got = repeats.collapse(edge)
    assert got.columns == [*[c for c in edge.columns if c != "runs"], "runs"] and got.count() == len(EDGE)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[6].text == "word" and [tuple(x) for x in by_id[6].runs] == [(0, 30_000, 1)]
    assert by_id[2].text is None and by_id[2].runs == [] and by_id[3].text == "" and by_id[8].text == ""
    assert by_id[1].text == A and by_id[7].text == "été 中文 \U0001f600 x" and by_id[7].lang == "fr"
    assert repeats.collapse(empty).count() == 0


def test_runs_do_not_depend_on_how_texts_are_batched(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = queries.looped(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", text.alias("text"))
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows.collect()}
    for r in repeats.collapse(rows).collect():
        runs = plain_runs(words[r.doc_id], 24, 3) if len(words[r.doc_id]) < 400 else [(x.start, x.period, x.length) for x in r.runs]
        assert [(x.start, x.period, x.length) for x in r.runs] == runs
        dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
        assert r.text == " ".join(w for i, w in enumerate(words[r.doc_id]) if i not in dropped)


# --- Jaccard join ---
def plain_set(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain_components(docs, percent=90):
    """docs: (id, text). The least id that each row with id reaches."""
    sets = [(i, plain_set(t)) for i, t in docs if i is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) - 9 and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (x, _) in enumerate(sets):
        least[find(i)] = min(x, least.get(find(i), x))
    return sorted((x, len(s), least[find(i)]) for i, (x, s) in enumerate(sets))


def chained(rng, groups, copies):
    """Texts in groups in which some are linked through others only."""
    out, n = [], 0
    for g in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 12, 40, 90, 300]))]
        for _ in range(copies):
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([60, 80, 100, 150]))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            out.append((n, " ".join(words)))
            n += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [1024, 8])
def test_components_are_those_of_all_pairs(spark, monkeypatch, piece):
    """With small pieces, large buckets are cut, and looked at within pieces first."""
    monkeypatch.setattr(sketches, "PIECE", piece)
    docs = chained(random.Random(piece), 8, 20) + [(1000 + i, t) for i, t in enumerate(["a b c", "a b c", "a b", "a", "", None, "x y z w"])]
    got = sketches.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert rows_of(got, ["doc_id", "n_shingles", "component_id"]) == sorted(plain_components(docs), key=str)


def test_joins_by_a_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sketches, "FEW", 0)
    docs = chained(random.Random(5), 4, 12)
    assert rows_of(sketches.join(spark.createDataFrame(docs, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id"]) == sorted(plain_components(docs), key=str)


@pytest.mark.parametrize("sample", [1, 64])
def test_keys_that_meet_are_shuffled_once(spark, monkeypatch, sample):
    """Hot keys (with all classes in the sample, those under which four or more are) and others: all that meet and no others."""
    monkeypatch.setattr(sketches, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    lists = [[int(k) for k in rng.choice([*range(8)] * 20 + [*range(100, 900)], 6)] for _ in range(300)]
    lists = [sorted(set(x)) for x in lists] + [[7], []]
    times = Counter(k for x in lists for k in x)
    found = sketches.meetings(spark.createDataFrame(list(enumerate(lists)), "node long, keys array<long>"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == sorted((k, i) for i, x in enumerate(lists) for k in x if times[k] > 1)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 600)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64)))
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(sketches.sketch(a) ^ sketches.sketch(b)).sum()) <= apart
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * len(np.union1d(a, b)):
            bands = sketches.edges(90, 10_000)
            keys = [set(sketches.signatures(x, 90, bands).tolist()) for x in (a, b)]
            assert keys[0] & keys[1] or (a == b).all() or len(a) < bands[0]


def test_keys_are_kept_once_a_class_and_not_to_the_end(spark, monkeypatch):
    """Keys come from the first row of a class where they are written, whatever its number, and no table that stays has them."""
    for few in (0, 500_000):
        monkeypatch.setattr(sketches, "FEW", few)
        rows = [(i, [i, -i]) for i in (0, 1, 63, 64, 127, (1 << 33) + 5, (5 << 33) + 63)]
        found = spark.createDataFrame(rows, "row long, keys array<long>")
        nodes = [0, 63, 127, (5 << 33) + 63]
        got = sketches.firsts(found, spark.createDataFrame([(i,) for i in nodes], "node long"))
        assert sorted((r.node, list(r["keys"])) for r in got.collect()) == [(i, [i, -i]) for i in nodes]
    since = common.mark(spark)
    sketches.join(spark.createDataFrame(chained(random.Random(5), 2, 8), "doc_id long, text string")).collect()
    stay = common._written(spark)[since:]
    assert stay and not any("keys" in spark.read.parquet(path).columns for path in stay)


def test_long_sketches_refute_what_short_ones_leave_open(spark):
    """Of sets of 900 to 1,200 members, on both sides of a power of two, none that link are refuted, and of those at a similarity of 0.8 all are."""
    rng = np.random.default_rng(3)
    own, pairs, links = [], [], []
    for i, n in enumerate([900, 1000, 1022, 1030, 1100, 1200] * 4):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep, more = (0.97, 0.02) if i % 2 else (0.9, 0.11)
        b = np.unique(np.append(a[rng.random(n) < keep], rng.integers(0, 1 << 62, int(n * more)).astype(np.uint64)))
        both, whole = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert (100 * both >= 90 * whole) == bool(i % 2)
        short = sketches.may_link(np.array([len(a)]), sketches.sketch(a)[None], np.array([len(b)]), sketches.sketch(b)[None], 90)
        assert short[0] or not i % 2
        links.append((2 * i, 2 * i + 1, bool(i % 2)))
        own += [(2 * i + j, len(x), x.view(np.int64).tolist(), sketches.long_sketch(x).view(np.int64).tolist()) for j, x in enumerate((a, b))]
    own = spark.createDataFrame(own, "node long, n long, hashes array<long>, bits array<long>")
    pairs = spark.createDataFrame([x[:2] for x in links], "u long, v long")
    assert sorted(map(tuple, sketches.sifted(pairs, own, 90).collect())) == links
    assert sorted(map(tuple, sketches.verified(pairs, own, 90).collect())) == links


def test_join_on_edges(spark, edge, empty):
    got = rows_of(sketches.join(edge), ["doc_id", "n_shingles", "component_id"])
    n = len(plain_set(A))
    want = [(1, n, 1), (2, 0, 2), (3, 0, 3), (4, n, 1), (4, n, 1), (None, n, None), (5, 1, 5), (6, 1, 6), (7, 1, 7), (8, 0, 8)]
    assert got == sorted(want, key=str)
    assert sketches.join(empty).count() == 0


# --- ranked search ---
def plain_search(docs, items, k=10):
    """docs: (id, text); items: (id, text). Rows (item, rank, doc, score)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(m for _, _, m in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(split(t))
    for item, terms in wanted.items():
        scores = []
        for at, (doc, c, m) in enumerate(counts):
            norm = 10 + (90 * m * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * norm)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("depth,shard", [(256, 2_000_000), (1, 40), (3, 1)])
def test_search_is_a_scan_of_all_documents(spark, monkeypatch, depth, shard):
    monkeypatch.setattr(lexical, "DEPTH", depth)
    monkeypatch.setattr(lexical, "SHARD", shard)
    rng = random.Random(depth)
    word = lambda: f"t{min(int(rng.expovariate(0.15)), 60)}"
    docs = [(i if i % 17 else None, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(14)] + [(3, docs[4][1]), (500, None), (501, "T1, t1!t2; Ünï中 T1")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(0, "ünï中 T1"), (90, docs[3][1]), (91, ""), (92, None), (None, "t1"), (93, "nowhere")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"))
    assert rows_of(got, ["item_id", "rank", "doc_id", "score"]) == plain_search(docs, items)


def test_searching_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TOGETHER", 5)
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(30)]
    items = [(i, f"a{i % 3} b{i % 4} c{i}") for i in range(8)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert rows_of(got, ["item_id", "rank", "doc_id", "score"]) == plain_search(docs, items, 4)


def test_search_on_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "cat moon"), (2, "12 word")], "item_id long, text string").withColumn("score", F.lit(0))
    got = rows_of(lexical.search(edge, items), ["item_id", "rank", "doc_id", "score"])
    assert got == plain_search([r[:2] for r in EDGE], [(1, "cat moon"), (2, "12 word")])
    assert lexical.search(empty, items).count() == 0 and lexical.search(edge, items.limit(0)).count() == 0


# --- what was mended in earlier operators ---
def test_equal_texts_without_id_are_repeats(spark):
    rows = spark.createDataFrame([(None, A, 1), (None, A, 2), (1, "x y z", 3), (None, None, 4)], "doc_id long, text string, k int")
    got = {r.k: r.text for r in substrings.dedup(rows).collect()}
    assert sorted([got[1], got[2]]) == ["", A] and got[3] == "x y z" and got[4] is None


def test_memory_of_long_words_is_bounded_in_bytes():
    import public_tokenizers

    from adloom.llm import bpe

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=200)) for _ in range(100)) for _ in range(200)]
    for made, module in ((bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), bpe), (packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), packing)):
        before, memory = list(made.encode(texts)), module.MEMORY
        try:
            module.MEMORY = 1 << 20
            again = list(made.encode(texts[:150] + texts[:150]))
            assert again == before[:150] * 2 and len(made.known) < 20_000
        finally:
            module.MEMORY = memory


def test_long_words_are_replayed_as_short_ones_are(monkeypatch):
    import public_tokenizers
    import tiktoken

    from adloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text = "中文" * 3000 + " " + "abcde" * 2000
    monkeypatch.setattr(bpe, "REPLAY", 1 << 10)
    got = np.frombuffer(next(bpe.Encoder(path, public_tokenizers.PATTERN).encode([text])), "<u4").tolist()
    assert got == library.encode_ordinary(text)


def test_headers_of_any_length(spark, tmp_path):
    import time

    url = "http://x.example/" + "a" * (10 << 20)
    for gzip in (False, True):
        data = warc.record(1, url, b"<p>hello</p>", 12, "A" * 32, None)
        path = tmp_path / f"long{gzip}.warc"
        path.write_bytes(warc.gzipped(data) if gzip else data)
        import pyarrow as pa

        f = pa.OSFile(str(path))
        began = time.time()
        head = (warc.Inflated(f) if gzip else warc.Plain(f)).head()
        assert url.encode() in head and time.time() - began < 5


def test_copies_are_few_and_the_search_is_tuned(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, told = neighbours.search(rows, rows.where("vec_id % 50 = 0"), 10)
    got = found.toPandas().groupby("query_id")["vec_id"].apply(set)
    d = ((x[::50, None, :] - x[None]) ** 2).sum(-1)
    d[np.arange(80), np.arange(0, 4000, 50)] = np.inf
    recall = np.mean([len(got[q * 50] & set(np.argsort(d[q])[:10].tolist())) / 10 for q in range(80)])
    assert recall >= 0.9 and told.agg(F.avg("scanned")).first()[0] < 0.5 * 4000
