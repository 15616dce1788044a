"""Language identification by rank-order n-gram profiles.

Method. A language's profile is the list of its most frequent letter n-grams (n = 1 to 3, words padded with a separator), most
frequent first. A document's own most frequent n-grams are ranked the same way; the out-of-place distance to a language sums, over
the document's n-grams, how far each is from its place in the profile, or a fixed penalty where the profile lacks it. The nearest
language wins, ties go to the first in alphabetical order. An n-gram that no profile has adds the same penalty for each language,
so the document's ranking is over n-grams that at least one profile has.

Null texts and texts without letters are `und` with score 0; so is every text if no labelled text was learned from. Training rows
without text or language teach nothing. Columns besides those named are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, struct_of, task_of

#: N-grams in a profile.
PROFILE = 400
UNKNOWN = "und"
#: The least score that counts as a language, under those of all labelled documents: the least of them is 0.466 in sf0.1, 0.438 in check_s.
LEAST = 0.4
SEP = ord("_")
#: Characters looked at together while counting.
PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else the separator."""
    table = np.full(sys.maxunicode + 1, SEP, np.uint32)
    for i in range(sys.maxunicode + 1):
        if chr(i).isalpha():
            table[i] = i
    return table


def letters(text: str) -> np.ndarray:
    """Lower-cased code points of the words of a text, one separator before, between and after them; empty if it has no letter."""
    a = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    sep = a == SEP
    keep = np.ones(len(a), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    a = a[keep]
    if not len(a) or (len(a) == 1 and a[0] == SEP):
        return a[:0]
    return np.concatenate((a[:0] if a[0] == SEP else [SEP], a, a[:0] if a[-1] == SEP else [SEP])).astype(np.uint32)


def _grams(a: np.ndarray, code: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Numbers of the n-grams of each length; a holds code points, code their numbers from 1 to below base."""
    c, sep = code.astype(np.int64), a == SEP
    yield c[~sep]
    yield c[:-1] * base + c[1:]
    inner = ~sep[1:-1]
    yield (c[:-2] * base * base + c[1:-1] * base + c[2:])[inner]


def count(texts: list[str]) -> dict[str, int]:
    """How often each n-gram occurs in the texts."""
    a = np.concatenate([letters(t) for t in texts]) if texts else np.zeros(0, np.uint32)
    if not len(a):
        return {}
    keep = np.ones(len(a), bool)
    keep[1:] = ~((a[1:] == SEP) & (a[:-1] == SEP))
    a = a[keep]
    chars, code = np.unique(a, return_inverse=True)
    base = len(chars) + 1
    signs = ["", *map(chr, chars)]
    found: dict[str, int] = {}
    for n, grams in enumerate(_grams(a, code + 1, base), 1):
        if base**n <= 1 << 21:
            counts = np.bincount(grams, minlength=1)
            values = np.flatnonzero(counts)
            counts = counts[values]
        else:
            values, counts = np.unique(grams, return_counts=True)
        for v, k in zip(values.tolist(), counts.tolist()):
            found["".join(signs[v // base**i % base] for i in range(n - 1, -1, -1))] = k
    return found


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """docs (text, lang). Returns (lang, gram, place): of each language the `size` most frequent n-grams, place from 0; equal counts by
    n-gram. All rows with text and lang are counted; counts are summed within tasks before they are shuffled."""
    out = struct_of("lang string, gram string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("language")
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            grams = count(held.pop(lang))
            sizes.pop(lang)
            return batch_of({"lang": [lang] * len(grams), "gram": list(grams), "n": list(grams.values())}, out)

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                text, lang = text.as_py(), lang.as_py()
                for at in range(0, len(text), PIECE):
                    held.setdefault(lang, []).append(text[at : at + PIECE])
                    sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                    if sizes[lang] >= PIECE:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    counted = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    sums = counted.mapInArrow(run, out).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The limit stands on the row number itself, so that tasks pass on their own first rows of a language only.
    return sums.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select("lang", "gram", (F.col("nth") - 1).alias("place"))


class Classifier:
    """The learned profiles, laid out so that a text's n-grams are looked up by indexing."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int) -> None:
        """rows: (lang, gram, place)."""
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        grams = sorted({r[1] for r in rows})
        at = {g: i for i, g in enumerate(grams)}
        # For each gram the languages that have it and its place there, one after another: as many numbers as the profiles have rows.
        number = {x: i for i, x in enumerate(self.langs)}
        entries = sorted((at[gram], number[lang], place) for lang, gram, place in rows)
        self.having = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)
        self.start = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(grams) + 1))
        signs = sorted({c for g in grams for c in g})
        self.base = len(signs) + 1
        self.signs = np.array([ord(c) for c in signs], np.uint32)
        number = {c: i + 1 for i, c in enumerate(signs)}
        # A gram's number is found through its prefix: prefix number * base + last sign.
        prefixes = {"": 0} | {p: i + 1 for i, p in enumerate(sorted({g[:k] for g in grams for k in (1, 2) if len(g) >= k}))}
        self.child = np.zeros(len(prefixes) * self.base, np.int32)  # of a prefix and a sign the longer prefix, or 0
        self.gram = np.full(len(prefixes) * self.base, -1, np.int32)
        for p, i in prefixes.items():
            if p:
                self.child[prefixes[p[:-1]] * self.base + number[p[-1]]] = i
        for g, i in at.items():
            self.gram[prefixes[g[:-1]] * self.base + number[g[-1]]] = i
        self.code: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        a = letters(text or "")
        if not len(a) or not self.langs:
            return UNKNOWN, 0.0
        if self.code is None:
            self.code = np.zeros(sys.maxunicode + 1, np.int32)
            self.code[self.signs] = np.arange(1, self.base)
        counts = np.zeros(len(self.start) - 1, np.int64)
        for at in range(0, len(a), PIECE):
            part = a[max(0, at - 2) : at + PIECE]
            skip = min(at, 2)
            c, sep = self.code[part].astype(np.int64), part == SEP
            one = self.gram[c][skip:][~sep[skip:]]
            first = self.child[c] * (c > 0)
            pair = first[:-1] * self.base + c[1:]
            two = np.where((first[:-1] > 0) & (c[1:] > 0), self.gram[pair], -1)[max(0, skip - 1) :]
            second = np.where((first[:-1] > 0) & (c[1:] > 0), self.child[pair], 0)
            three = np.where((second[:-1] > 0) & (c[2:] > 0) & ~sep[1:-1], self.gram[second[:-1] * self.base + c[2:]], -1)
            for found in (one, two, three):
                counts += np.bincount(found[found >= 0], minlength=len(counts))
        own = np.flatnonzero(counts)
        own = own[np.lexsort((own, -counts[own]))][: self.size]
        if not len(own):
            return self.langs[0], 0.0
        n = self.start[own + 1] - self.start[own]
        entry = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        saved = self.size - np.abs(self.place[entry] - np.repeat(np.arange(len(own)), n))  # of the penalty for a gram that is missing
        distance = self.size * len(own) - np.bincount(self.having[entry], saved, len(self.langs)).astype(np.int64)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


    def accepts(self, text: str | None, score: float, least: float) -> bool:
        """Whether a text is in one of the languages: a score of `least` or more, and half of its letters or more in some profile."""
        if score < least or score <= 0:
            return False
        a = letters(text or "")
        a = a[a != SEP]
        return bool(2 * np.isin(a, self.signs).sum() >= len(a))


def learn(docs: DataFrame, size: int = PROFILE) -> Classifier:
    """The classifier learned from docs (text, lang). The driver gets `size` rows a language."""
    return Classifier([tuple(r) for r in profiles(docs, size).collect()], size)


def identify(docs: DataFrame, learned: Classifier, keep: list[str | Column], least: float | None = None) -> DataFrame:
    """The columns `keep` of docs (text, ...) with lang_pred string and score double, in place of any columns of these names. The text
    alone decides. With `least`, a text that no profile accepts at that score is `und`."""
    own = docs.select(*keep).drop("lang_pred", "score").columns
    own = docs.select(*keep, F.col("text").cast("string").alias(next(n for n in ("_text", "_text_", "_text__") if n not in own))).drop("lang_pred", "score")
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*own.schema.fields[:-1], *struct_of("lang_pred string, score double").fields])
    arrow = to_arrow_schema(schema)
    known = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("language")
        for b in batches:
            found = [known.value.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            if least is not None:
                found = [(lang if known.value.accepts(x.as_py(), score, least) else UNKNOWN, score) for x, (lang, score) in zip(b.column(b.num_columns - 1), found)]
            kept = [b.column(i).cast(f.type) for i, f in enumerate(list(arrow)[:-2])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=arrow)

    return own.mapInArrow(run, schema)
