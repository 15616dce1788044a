"""Language ID, near-duplicates, passages, fingerprints and byte-level BPE against plain Python."""

import base64
import hashlib
import re

import numpy as np
import pytest
import xxhash

from adloom.llm import bpe, imatch, language, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A = "The cat sat on the mat and looked at the moon for a long time. It was a quiet night in the village. Nobody was awake."
EDGE = [(1, A, "en", "s", 1), (2, None, None, "s", 0), (3, "", "en", None, 0), (4, A, "en", "s", 1), (4, A, "en", "s", 1), (None, A, "en", "s", 1), (5, "12 34 !!", "en", "s", 8), (6, "word " * 30_000, "en", "s", 150_000), (7, "été 中文 \U0001f600", "fr", "s", 8)]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with nulls, an empty and a very long text, ties, repeated rows and columns whose names operators also use."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, DOCS).withColumn("fp", F.lit(1)).withColumn("score", F.lit("x")).withColumn("removed", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=4):
    """prints: (id, fingerprint). The least id reachable of each."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_near_duplicates_are_those_of_brute_force(real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = plain_components(prints)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(real).collect()}
    assert got == {i: (p, want[i]) for i, p in prints}


def test_near_duplicates_of_edge_cases(edge, empty):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(edge).collect()}
    print_a = plain_fingerprint(A)
    print_a = print_a - (1 << 64) if print_a >> 63 else print_a
    assert (1, print_a, 1) in got and (4, print_a, 1) in got and (None, print_a, None) in got
    assert (2, 0, 2) in got and (3, 0, 2) in got
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = sorted((r.doc_id or 0) for r in simhash.keep_one(edge).collect())
    assert kept == [0, 1, 2, 5, 6, 7]


def test_hot_fingerprints_are_broadcast(edge, monkeypatch):
    from adloom.llm import common

    rows = lambda: sorted(tuple(r) for r in simhash.near_duplicates(edge.where("doc_id is not null")).collect())
    before = rows()
    monkeypatch.setattr(common, "join_counted", lambda *a, f=common.join_counted: f(*a[:4], 3))
    monkeypatch.setattr(simhash, "join_counted", common.join_counted)
    assert rows() == before


def test_one_of_rows_that_repeat_an_id_stays(spark):
    rows = [(1, "a text of several words that is its own", "x"), (1, "another text of several words, not like it", "y"), (1, "another text of several words, not like it", "y"), (2, "the third of the texts here", "z"), (None, "a text of several words that is its own", "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((r.doc_id or 0, r.source) for r in simhash.keep_one(df.repartition(n)).collect()) for n in (1, 2, 4)]
    assert got[0] == got[1] == got[2] and [i for i, _ in got[0]] == [0, 0, 1, 2] and got[0][2][1] in "xy"


def test_stage_links_texts_by_five_word_similarity(spark):
    """Of 60 words one other word in the middle leaves 51 of 61 shingles shared, two leave 46 of 66."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(0, 120, 3):
        words = [f"W{x}" for x in rng.integers(0, 5000, 60)]
        one, two = words[:30] + ["other"] + words[31:], words[:20] + ["other"] + words[21:40] + ["another"] + words[41:]
        rows += [(i, " ".join(words)), (i + 1, "  ".join(one).lower()), (i + 2, " ".join(two))]
        want |= {i: i, i + 1: i, i + 2: i + 2}
    assert {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(want.values())


def test_forest_connects_what_is_connected_at_each_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    prints = base[rng.integers(0, 3, 300)] ^ (rng.integers(0, 1 << 63, (300, 4)) & rng.integers(0, 1 << 63, (300, 4)) & rng.integers(0, 1 << 63, (300, 4)) & rng.integers(0, 1 << 63, (300, 4))).astype(np.uint64)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)

    def groups(links):
        parent = list(range(len(prints)))
        for a, b in links:
            simhash._join(parent, a, b)
        find = lambda x: x if parent[x] == x else find(parent[x])
        return [find(i) for i in range(len(prints))]

    found = simhash.forest(prints, 40)
    for bound in (15, 20, 25, 30, 40):
        assert groups([(a, b) for a, b in found if d[a, b] <= bound]) == groups(np.argwhere(d <= bound).tolist())


def test_links_within_a_bucket_that_is_cut_into_tiles(spark, monkeypatch):
    """Chains of fingerprints that differ in few bits, all in one bucket, with pieces of a few rows."""
    monkeypatch.setattr(simhash, "PIECE", 8)
    rng = np.random.default_rng(1)
    prints = [0]
    for _ in range(60):
        x = prints[-1]
        for b in rng.choice(24, 3, replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints) | {(1 << 63) | 5, (1 << 40) - 1, (1 << 40) + 3})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from adloom.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    signed = [(p - (1 << 64) if p >> 63 else p) for p in prints]
    want = plain_components([(s, s & (1 << 64) - 1) for s in signed])
    groups = lambda d: {frozenset(k for k in signed if d.get(k, k) == r) for r in {d.get(k, k) for k in signed}}
    assert groups(roots) == groups(want)


@pytest.mark.parametrize("n", [1, 10_000_000, 10**10, 10**15])
def test_masks_meet_every_pair_within_the_radius(n):
    rng = np.random.default_rng(n % 97)
    masks = simhash.masks(n, 4)
    for _ in range(200):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not bits & m for m in masks)


def test_passages_go_from_all_but_the_earliest(spark):
    passage = " ".join(f"Word{i} and more of it stands in sentence number {i}." for i in range(8))
    rows = [(3, f"Own start here. {passage} Own end."), (1, f"First one says this. {passage}"), (2, "Nothing shared. Short."), (5, "Short."), (4, f"{passage}\n{passage}")]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[1][1] and got[2].text == rows[2][1] and got[5].text == "Short."
    assert got[3].text == "Own start here. Own end."
    assert got[4].text == ""
    for doc_id, text in rows:
        kept, at = [], 0
        for span in got[doc_id].removed:
            kept.append(text[at : span.start])
            at = span.end
        assert "".join(kept) + text[at:] == got[doc_id].text


def test_repeated_lines_go_whatever_their_length(spark):
    rows = [(1, "Menu\nOne text of its own.\nRead more here"), (2, "Menu\nAnother one, which differs.\nRead more here"), (3, "The Menu. Menu of it.\nmenu"), (4, "It says: Read more here")]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Another one, which differs.\n", 3: "The Menu. Menu of it.\n", 4: rows[3][1]}


@pytest.mark.parametrize("stops", [(), (30,), (25, 33)])
def test_passages_that_begin_and_end_inside_sentences_are_cut(spark, stops):
    """51 words whose ends are inside longer sentences, with no, one and two sentence ends between: what goes is theirs alone, and
    no document keeps a run of WINDOW + STEP - 1 words of an earlier one."""
    rng = np.random.default_rng(6)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = " ".join(w + "." * (i in stops) for i, w in enumerate(own(51).split()))
    rows = [(i, f"{own(40 + i)} {shared} {own(45 + i)}.") for i in range(30)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i, text in rows[1:]:
        at, (start, end) = text.index(shared), got[i].removed[0]
        assert len(got[i].removed) == 1 and at <= start and end <= at + len(shared) + 1 and len(text[start:end].split()) >= substrings.WINDOW
        assert len(text[at:start].split()) < substrings.STEP and len(text[end : at + len(shared)].split()) < substrings.STEP


def plain_dedup(rows, min_words):
    """rows (doc_id, text) with different ids. Sentences, lines and windows as lists of words, compared with those of all earlier documents."""
    earlier, out = set(), {}
    for doc_id, text in sorted(rows):
        own, spans, seen, run = set(), [], set(), []
        for m in re.finditer(r"[^\n]*(?:\n\s*|$)", text):
            line = tuple(m[0].casefold().split())
            if 0 < len(line) < min_words:
                own.add(("line", line))
                if ("line", line) in earlier or ("line", line) in seen:
                    spans.append(m.span())
                seen.add(("line", line))
        cuts = [0, *(m.end() for m in re.finditer(r"\n\s*|(?<=[.!?])[^\S\n]+", text)), len(text)]
        for a, b in [*zip(cuts, cuts[1:]), (None, None)]:
            words = tuple(text[a:b].casefold().split()) if a is not None else ("end",)
            if not words:
                continue
            if a is not None and (("unit", words) in earlier or ("unit", words) in seen):
                run.append((a, b, len(words)))
            else:
                if sum(n for _, _, n in run) >= min_words:
                    spans.append((run[0][0], run[-1][1]))
                run = []
            own.add(("unit", words))
            seen.add(("unit", words))
        digests, words, places = substrings.windows(text), text.casefold().split(), [m.span() for m in re.finditer(r"\S+", text)]
        n = len(words) - substrings.WINDOW + 1
        picked = {min(range(i, min(i + substrings.STEP, n)), key=lambda j: (digests[j, 0], j)) for i in range(max(1, n - substrings.STEP + 1))} if n > 0 else set()
        for i in picked:
            unit = ("window", tuple(words[i : i + substrings.WINDOW]))
            own.add(unit)
            if unit in earlier:
                end = places[i + substrings.WINDOW - 1][1]
                spans.append((places[i][0], end + len(re.match(r"[^\S\n]*", text[end:])[0])))
        gone = {i for a, b in spans for i in range(a, b)}
        out[doc_id] = "".join(c for i, c in enumerate(text) if i not in gone)
        earlier |= own
    return out


def test_passages_are_those_of_brute_force(real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").where("text is not null").collect()]
    got = substrings.dedup(real.select("doc_id", "text")).collect()
    texts = dict(rows)
    assert {r.doc_id: r.text for r in got if r.text is not None} == plain_dedup(rows, substrings.MIN_WORDS)
    for r in got:
        if r.text is not None:
            kept, at = [], 0
            for span in r.removed:
                kept.append(texts[r.doc_id][at : span.start])
                at = span.end
            assert "".join(kept) + texts[r.doc_id][at:] == r.text


def test_windows_are_runs_of_words():
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 3, 200)]
    digests = substrings.windows(" ".join(words))
    runs = [tuple(words[i : i + substrings.WINDOW]) for i in range(len(words) - substrings.WINDOW + 1)]
    assert len(digests) == len(runs) and len({tuple(d) for d in digests.tolist()}) == len(set(runs))
    again = substrings.windows(" ".join(words[50:]))
    assert (again == digests[50:]).all() and (digests[:, 1] & 1 == 1).all()


def test_passages_of_rows_without_id(spark):
    """They come last and lose to each other what they share; of equal texts one stays."""
    passage = "One passage of quite a few words that several rows have in common."
    rows = [(None, f"{passage} First of its kind here."), (None, f"{passage} Second of its kind here."), (None, "All of this text stands twice here."), (None, "All of this text stands twice here."), (7, f"{passage} With a number of its own.")]
    got = sorted(r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[4][1], "First of its kind here.", "Second of its kind here.", rows[2][1], ""])


def test_hot_digests_are_broadcast_and_others_joined(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 8)
    rows = [(i, f"This line stands in every document there is.\nThis line number {i // 2} stands in two of them.\nOwn line {i} of one document.") for i in range(60)]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_dedup(rows, substrings.MIN_WORDS) and got[1] == "Own line 1 of one document."


def test_passages_of_edge_cases(edge, empty):
    rows = substrings.dedup(edge, 10).collect()
    assert len(rows) == len(EDGE)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == A and by[4][0].text == by[4][1].text == "" and by[None][0].text == ""
    assert by[2][0].text is None and by[2][0].removed == [] and by[3][0].text == ""
    assert substrings.dedup(empty).count() == 0


def test_language_of_held_out_documents(real):
    from adloom.llm.queries import held_out
    from pyspark.sql import functions as F

    learned = language.learn(real.where(~held_out(F.col("doc_id"))))
    rows = language.identify(real.where(held_out(F.col("doc_id"))), learned, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_stage_drops_what_no_profile_covers(spark, real):
    import corpus_pipeline

    rows = [(90_001, "Привет, как дела сегодня, мы идём в лес", None, "s", 1), (90_002, "这是一个中文句子", "en", "s", 1), (90_003, "Привет всем из нашего леса OK", None, "s", 1), (90_004, "The cat looked at the moon for a long time.", "fr", "s", 1), (90_005, "The cat looked at the moon for a long time.", None, "s", 1)]
    kept = corpus_pipeline.language_id(spark, real.unionByName(spark.createDataFrame(rows, real.schema)), "").collect()
    assert {r.doc_id: r.lang for r in kept if r.doc_id > 90_000} == {90_004: "en", 90_005: "en"}
    assert len(kept) == real.count() + 2


def plain_count(texts):
    found = {}
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f"_{word}_"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g != "_":
                        found[g] = found.get(g, 0) + 1
    return found


def plain_predict(profiles, text, size):
    counts = {g: n for g, n in plain_count([text]).items() if any(g in p for p in profiles.values())}
    own = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    distance = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(distance), key=distance.get) if own else None
    return (best, 1 - distance[best] / (size * len(own))) if own else (None, 0.0)


def test_language_is_that_of_brute_force(real):
    rows = [(r.text, r.lang) for r in real.select("text", "lang").limit(80).collect()]
    size, profiles = 100, {}
    for lang in {x[1] for x in rows}:
        counts = plain_count([t for t, x in rows if x == lang])
        profiles[lang] = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:size])}
    got = {}
    for r in language.profiles(real.sparkSession.createDataFrame(rows, "text string, lang string"), size).collect():
        got.setdefault(r.lang, {})[r.gram] = r.place
    assert got == profiles
    learned = language.Classifier([(x, g, i) for x, p in profiles.items() for g, i in p.items()], size)
    for text, _ in rows:
        assert learned.predict(text) == pytest.approx(plain_predict(profiles, text, size))


def test_language_of_edge_cases(edge, empty):
    rows = language.identify(edge, language.learn(edge), ["doc_id", "score"]).toPandas()
    assert list(rows.columns) == ["doc_id", "lang_pred", "score"]
    assert set(rows[rows.doc_id.isin([2, 3, 5])].lang_pred) == {"und"}
    nothing = language.identify(edge, language.learn(empty), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify(empty, language.learn(edge), ["doc_id"]).count() == 0


def test_fingerprints_of_texts_edited_and_next(real):
    rows = sorted((r.doc_id, r.text or "") for r in real.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in imatch.compare(real).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()
        assert got[i].n_chars == len(text)
    same = {}
    for i, text in rows:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.3


def subset_of(term, family):
    """The last of a family's nested subsets that the term is in: k if the term's mixed hash ends in k zero bits."""
    m = (1 << 64) - 1
    x = xxhash.xxh64_intdigest(term) ^ xxhash.xxh64_intdigest(f"lexicon {family}")
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ x >> 30) * factor) & m
    x ^= x >> 31
    return next((k for k in range(64) if x >> k & 1), 64)


def test_fingerprints_are_those_of_brute_force(real):
    """All subsets of the lexicon are laid out as sets before any document is looked at, and each document is hashed over every one."""
    rows = sorted((r.doc_id, r.text or "") for r in real.select("doc_id", "text").collect())
    rows = [*rows[:60], (rows[60][0], ""), (rows[61][0], "zzzz only here")]
    docs = [(i, t) for i, t in rows]
    counts = {}
    for _, t in docs:
        for w in set(re.findall(r"\w+", t.lower())):
            counts[w] = counts.get(w, 0) + 1
    band = (0.02, 0.3)
    lexicon = {w for w, n in counts.items() if max(2, band[0] * len(docs)) <= n <= band[1] * len(docs)}
    subsets = [[{w for w in lexicon if subset_of(w, f) >= k} for k in range(20)] for f in range(8)]

    def kept(text, family, k):
        own = set(re.findall(r"\w+", text.lower()))
        known = own & lexicon
        return frozenset(known & subsets[family][k] if known else {w for w in own if subset_of(w, family) >= k})

    def value(text, family):
        k = max((k for k in range(20) if kept(text, family, k)), default=None)
        return 0 if k is None else xxhash.xxh32_intdigest(" ".join(sorted(kept(text, family, k))))

    def likeness(a, b):
        same = 0
        for f in range(8):
            k = max((k for k in range(20) if kept(a, f, k) or kept(b, f, k)), default=0)
            same += kept(a, f, k) == kept(b, f, k)
        return same / 8

    got = {r.doc_id: r for r in imatch.compare(real.sparkSession.createDataFrame(docs, "doc_id long, text string"), band, 8).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        k, r = len(text) // 4, got[i]
        changed = text[: len(text) - k] + following[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{value(text, f):08x}" for f in range(8)) and r.edited_fingerprint == "".join(f"{value(changed, f):08x}" for f in range(8))
        assert r.near_edited == likeness(text, changed) and r.near_next == likeness(text, following)


def test_fingerprints_of_rows_that_share_an_id(spark):
    """They follow each other in the order of a hash of their text, wherever ranges are cut."""
    rows = [(i // 3, f"text number {i} of some words") for i in range(60)] + [(None, "first of all"), (None, "or second")]
    got = {r.edited_sha256: r for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    order = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("coalesce(doc_id, -1) as i", "text", "xxhash64(text) as h").orderBy("i", "h").collect()
    assert len(got) == len(rows)
    for a, b in zip(order, order[1:] + order[:1]):
        k = len(a.text) // 4
        assert got[hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest()].doc_id == (None if a.i < 0 else a.i)


def test_fingerprints_of_edge_cases(edge, empty, spark):
    rows = imatch.compare(edge).collect()
    assert len(rows) == len(EDGE)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 4, None)}) == 1
    assert {r.near_edited for r in rows if r.doc_id in (2, 3)} == {1.0}
    assert imatch.compare(empty).count() == 0
    one = imatch.compare(spark.createDataFrame([(9, "abcd efgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one[0].near_next == 1.0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_that_of_the_library(real, tokenizer):
    path, pattern, library = tokenizer
    rows = bpe.decode(bpe.encode(real, path, pattern, ["doc_id", "text"]).select("doc_id", "text", "ids"), path, pattern, ["doc_id", "text", "ids"]).collect()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_odd_texts(tokenizer):
    path, pattern, library = tokenizer
    texts = ["", " ", "\n\n  \t x", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'VE", "é́中文\U0001f600\U0001f600", "1234567 89", "\x1c\x1d  ", "<|endoftext|>", "ab" * 500, "İßΣ"]
    for text, ids in zip(texts, bpe.Encoder(path, pattern).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_merges_of_lower_rank_that_appear_later_come_next():
    """bc has a higher rank than abc, so the pair (a, bc) is found only after its rank has passed."""
    import random

    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 300, b"abcabc": 258, b"cab": 259}
    v = bpe.Vocabulary(ranks)

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcx") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert v.encode(words) == [plain(w) for w in words]


def test_bpe_of_edge_cases(edge, empty, tokenizer):
    path, pattern, _ = tokenizer
    rows = bpe.encode(edge, path, pattern, ["doc_id", "score"]).collect()
    assert len(rows) == len(EDGE) and all(len(r.ids) == 0 for r in rows if r.doc_id in (2, 3))
    assert bpe.encode(empty, path, pattern, ["doc_id"]).count() == 0
