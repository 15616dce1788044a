"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Method. All distinct words of a batch of documents are laid out one after another as token ids. An inverted index leads from the rank
of a merge to the positions where a pair of neighbours would give it. Merges are replayed in rank order over all words at once:
the positions of the least rank are merged from left to right, and only the pairs with the two touched neighbours are looked up
anew. A pair that a merge creates may have a lower rank than the merge itself (vocabularies of ranks don't say by which pair a
token was built); such a rank is then next, as it is in a word-by-word encoder.

Words are the matches of the pattern; encoded words are kept between batches in a memory of bounded size, so each worker replays the
words of all its tasks about once. Long words cost as many bytes as they have, so the memory is bounded in bytes, whatever the words. (One replay for the whole corpus would send every occurrence of a word through a shuffle to meet
its ids; see the README for what that costs.) Null and empty texts have no tokens, repeated rows are encoded each for itself. Special
tokens are never produced. Columns besides those named are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import task_of

#: Bytes of encoded words that a worker keeps; beyond that it starts anew. Bytes of words that are replayed at once; a longer word is alone.
MEMORY, REPLAY = 100 << 20, 1 << 19
#: Rows of a batch that are handled together.
ROWS = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        #: Of each token, the tokens that may follow it in a pair, with the rank of what the pair makes.
        none: dict[int, int] = {}
        self.after: list[dict[int, int]] = [none] * (max(self.token, default=-1) + 1)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    if self.after[a] is none:
                        self.after[a] = {}
                    self.after[a][b] = rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token as a whole is that token, by whatever merges it could be reached."""
        whole = [self.ranks.get(w) for w in words]
        after, single = self.after, self.single
        # All words one after another: ids, the neighbours of each position, and behind the last an id that pairs with nothing.
        # Of words with many bytes the numbers are held in arrays, 12 bytes each; lists are faster while they are short.
        long = sum(map(len, words)) > 2 * REPLAY
        ids = array("i") if long else []
        spans: list[tuple[int, int]] = []
        index: dict[int, list[int]] = {}
        for w, r in zip(words, whole):
            start = len(ids)
            if r is None:
                ids.extend(single[c] for c in w) if long else ids.extend([single[c] for c in w])
            spans.append((start, len(ids)))
        total = len(ids)
        ids.append(-1)
        right, left = (array("i", x) if long else list(x) for x in (range(1, total + 2), range(-1, total)))
        for start, end in spans:
            if start == end:
                continue
            left[start], right[end - 1] = -1, total
            a = ids[start]
            for i in range(start, end - 1):
                b = ids[i + 1]
                if (r := after[a].get(b)) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                a = b
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            at = index.pop(rank, None)
            if at is None:
                continue
            at.sort()
            follow, lower = after[rank], False
            for n, i in enumerate(at):
                a, j = ids[i], right[i]
                if a < 0 or after[a].get(ids[j]) != rank:
                    continue  # a neighbour was merged meanwhile
                k, h = right[j], left[i]
                ids[i], ids[j], right[i], left[k] = rank, -1, k, i
                if (r := follow.get(ids[k])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(ranks, r)
                    lower |= r < rank
                if h >= 0 and (r := after[ids[h]].get(rank)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(ranks, r)
                    lower |= r < rank
                if lower:  # a pair of lower rank has come up: it is next, and the rest of this rank waits
                    if n + 1 < len(at):
                        index[rank] = at[n + 1 :]
                        heapq.heappush(ranks, rank)
                    break
        return [[x for x in ids[s:e] if x >= 0] if r is None else [r] for (s, e), r in zip(spans, whole)]


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        self.words = Vocabulary(load_ranks(path))
        if min(self.words.single) < 0:
            raise ValueError(f"{path} lacks single bytes")
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.size = 0
        size = max(self.words.token) + 1
        self.table = [self.words.token.get(i) for i in range(size)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Texts are taken together, some million characters at a time."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= 1 << 21:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.find(t) for t in texts]
        if self.size > MEMORY:
            self.known.clear()
            self.size = 0
        order, at = list(set().union(*split).difference(self.known)), 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size + 4 * len(order[to]) <= REPLAY):
                size += 4 * len(order[to])
                to += 1
            some, at = order[at:to], to
            for w, ids in zip(some, self.words.encode([w.encode() for w in some])):
                self.known[w] = pack(f"<{len(ids)}I", *ids)
                self.size += 200 + 4 * (len(w) + len(ids))
        get = self.known.__getitem__
        for i, words in enumerate(split):
            split[i] = []
            yield b"".join(map(get, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def _mapped(docs: DataFrame, keep: list[str | Column], source: Column, name: str, kind: T.DataType, run) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = docs.select(*keep, source.alias("_source")).drop(name)  # a column of the result's name is replaced
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(name, kind)])
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("bpe", encoder.cache_clear)
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                kept = [b.column(i).cast(f.type) for i, f in enumerate(list(arrow)[:-1])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(run(b.column(b.num_columns - 1)), arrow.field(name).type)], schema=arrow)

    return own.mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The columns `keep` of docs and `ids` binary: the ids of the whole text, little-endian unsigned 32-bit integers. Each document
    is read once and encoded where it is; nothing is shuffled. path: a rank file that every executor has."""
    return _mapped(docs, keep, F.coalesce(F.col(text).cast("string"), F.lit("")), "ids", T.BinaryType(), lambda c: list(encoder(path, pattern).encode(x.as_py() for x in c)))


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str | Column], ids: str = "ids") -> DataFrame:
    """The columns `keep` and `decoded` binary: the bytes that the ids stand for. Null ids give no bytes."""
    return _mapped(encoded, keep, F.coalesce(F.col(ids), F.lit(b"")), "decoded", T.BinaryType(), lambda c: [encoder(path, pattern).decode(x.as_py()) for x in c])
