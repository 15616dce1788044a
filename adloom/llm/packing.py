"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

Method. Pieces of equal length are interchangeable, so a plan needs only how many pieces there are of each length: as many numbers
as a sequence has tokens, whatever the corpus holds. The plan is made from these by bin completion: around the longest remaining
piece, fillings of the rest of the sequence are enumerated that no other filling dominates, those that waste too much to beat
the incumbent are pruned, and the best-fitting one is taken as often as the counts allow. That is the incumbent; while it needs
more sequences than the bound from below, branch and bound over the fillings tries to do the last sequences better. The
pieces then look up their place in the plan by their rank among the pieces of their length, which tasks count on their own and a
prefix sum over tasks makes global.

Null texts are empty texts. A piece of no tokens (only where no end token is added) takes no part. Rows without doc_id and rows
that repeat one are packed like others. Columns besides those named are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import batch_of, saved, struct_of, task_of

#: Fillings looked at for a sequence, and in all while the last sequences are done over.
FILLINGS, NODES = 400, 20_000
#: Sequences at the end of the plan that branch and bound may do over.
TAIL = 24
#: Bytes of encoded words that a worker keeps, about a million words; beyond that it starts anew.
MEMORY = 240 << 20
#: A comma or full stop that ends a word of ASCII letters: the two are encoded apart.
STOP = re.compile(r"([a-z])([,.])(?=[ \n])")
#: White space to str.split(), but part of a word to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")

Pattern = tuple[tuple[int, int], ...]  # length and how often, longest first


class WordEncoder:
    """A tokenizer file whose text is lower-cased and split at white space, and letters from what isn't, before anything else; for others
    there is a ValueError. So each word is encoded once and looked up after; a comma or full stop behind a word, and capitals of ASCII
    letters, don't make another word of it. Ids are those of the library's encode with add_special_tokens=False: a special token's
    string in a text is that token."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        words = ("ab", "cd", ",", "ef", ".", ",")
        if ids("Ab cd,\n\tEF. ,") != [i for x in words for i in ids(x)] or ids("ab cd") != [t.id for x in words[:2] for t in self.tokenizer.model.tokenize(x)]:
            raise ValueError(f"{path} doesn't encode lower-cased words one by one")
        self.special = re.compile("|".join(re.escape(x.content.lower()) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.find = re.compile(r"[^ \n\r\t]+").findall
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def base(self, word: str) -> str:
        """The part of a word that is encoded: without one comma or full stop behind a letter that the normaliser leaves a letter (a mark
        would join the stop), in lower case if it is ASCII and has no special token's letters, whose case counts."""
        if word[-1] in ",." and word[-2:-1].isalpha() and (word[-2].isascii() or unicodedata.normalize("NFC", word[-2]).lower().isalpha()):
            word = word[:-1]
        return word.lower() if word.isascii() and not ("<" in word and self.special.search(word.lower())) else word

    def _learn(self, bases: list[str]) -> None:
        """Encodes words. One of small ASCII letters is one word to the tokenizer too, and nothing normalises it, so it goes straight to the
        merges. Other words of letters are encoded many as one text, and the ids cut behind each token that ends a word; where the count
        shows that they aren't one word each, and for all other words, each is encoded by itself."""
        merges, known = self.tokenizer.model.tokenize, self.known
        plain, alone = [], []
        for w in bases:
            if not w.isalpha():
                alone.append(w)
            elif w.isascii() and w.islower():
                ids = [t.id for t in merges(w)]
                known[w] = packed(f"<{len(ids)}I", *ids)
            else:
                plain.append(w)
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(group):
                alone += group
                continue
            data = ids.tobytes()
            for word, start, end in zip(group, [0, *ends], ends):
                known[word] = data[start:end]
        for word, encoded in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            known[word] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Texts are taken together, a million characters at a time."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= 1 << 20:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.find(t) if SEPARATORS.search(t) else STOP.sub(r"\1 \2", t).split() for t in texts]
        if self.size > MEMORY:
            self.known.clear()
            self.size = 0
        new = set().union(*split).difference(self.known)
        parts = {w: self.base(w) for w in new}
        self._learn(list({*parts.values(), ",", "."}.difference(self.known)))
        for word, base in parts.items():
            if word not in self.known:
                self.known[word] = self.known[base] + (self.known[word[-1]] if len(word) > len(base) else b"")
        self.size += 160 * len(new) + 8 * sum(map(len, new)) + sum(len(self.known[w]) for w in new)
        get = self.known.__getitem__
        for i, own in enumerate(split):
            split[i] = []
            yield b"".join(map(get, own))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int | None) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, piece, start, length, ids_crc32, task, nth): each document's ids and the end id, cut where they
    are longer than capacity; nth counts the pieces of a length within a task."""
    out = struct_of("doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task_of("packing", word_encoder.cache_clear)
        encoder, task, seen = word_encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            found: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(x.as_py() or "" for x in b.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    found.append((doc_id, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if found:
                yield batch_of(dict(zip(out.fieldNames(), map(list, zip(*found)))), out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def fillings(counts: dict[int, int], room: int, limit: int, most_waste: int) -> list[tuple[int, Pattern]]:
    """Waste and filling: fillings of the room that no other dominates and that waste at most most_waste, least waste first.

    A filling is dominated if one of its pieces could make way for a longer one that is left and fits. Enumeration goes from
    long to short pieces, stops at a filling without waste or after `limit` steps, and leaves a branch when even the smallest
    remaining waste can't be under the best so far.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    found: list[tuple[int, Pattern]] = []
    steps = 0

    def dominated(filling: list[tuple[int, int]], slack: int) -> bool:
        used = dict(filling)
        for x in used:
            for y in lengths:
                if y <= x:
                    break
                if y - x <= slack and counts[y] > used.get(y, 0):
                    return True
        return False

    def go(i: int, room: int, filling: list[tuple[int, int]]) -> bool:
        """True when a filling without waste was found."""
        nonlocal steps
        steps += 1
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if i == len(lengths):
            if room <= most_waste and not dominated(filling, room):
                found.append((room, tuple(filling)))
            return room == 0 and bool(found)
        used = dict(filling)
        if counts.get(room, 0) > used.get(room, 0):
            i = max(i, lengths.index(room))  # one piece fills the room exactly
        for j in range(i, len(lengths)):
            x = lengths[j]
            for n in range(min(counts[x], room // x), 0, -1):
                if go(j + 1, room - n * x, [*filling, (x, n)]):
                    return True
                if steps > limit:
                    return False
            if sum_below[j + 1] < room - most_waste:
                break  # what is shorter can't fill enough
        else:
            if room <= most_waste and not dominated(filling, room):
                found.append((room, tuple(filling)))
        return False

    sum_below = [0] * (len(lengths) + 1)
    for j in range(len(lengths) - 1, -1, -1):
        sum_below[j] = min(room + most_waste, sum_below[j + 1] + lengths[j] * counts[lengths[j]])
    go(0, room, [])
    return sorted(dict.fromkeys(found), key=lambda f: f[0])


def _best_fit(counts: dict[int, int], room: int) -> Pattern:
    """The filling that takes the longest piece that fits, again and again."""
    filling = []
    for x in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        if n := min(counts[x], room // x):
            filling.append((x, n))
            room -= n * x
    return tuple(filling)


def _bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: one for each piece of over half a sequence, and room for all tokens."""
    return max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The best of the bounds that one gets by leaving out pieces shorter than some length a: pieces longer than capacity - a have a
    sequence to themselves, others of over half one each, and what is left must go into the room beside those or into more."""
    x = np.array(sorted(k for k, n in counts.items() if n), np.int64)
    if not len(x):
        return 0
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    best = _bound(counts, capacity)
    for a in x[2 * x <= capacity].tolist():
        alone, large, small = x > capacity - a, (x <= capacity - a) & (2 * x > capacity), (2 * x <= capacity) & (x >= a)
        room = n[large].sum() * capacity - (n * x)[large].sum()
        best = max(best, int(n[alone].sum() + n[large].sum() + max(0, -(-((n * x)[small].sum() - room) // capacity))))
    return best


def _greedy(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    left, out = dict(counts), []
    order = sorted(left, reverse=True)
    for longest in order:
        while left[longest]:
            left[longest] -= 1
            room = capacity - longest
            best = fillings(left, room, FILLINGS, room)
            fit = _best_fit(left, room)
            waste = room - sum(x * n for x, n in fit)
            filling = best[0][1] if best and best[0][0] < waste else fit
            left[longest] += 1
            whole = Counter({longest: 1})
            for x, n in filling:
                whole[x] += n
            times = min(left[x] // n for x, n in whole.items())
            for x, n in whole.items():
                left[x] -= n * times
            out.append((tuple(sorted(whole.items(), reverse=True)), times))
    return out


def _search(counts: dict[int, int], capacity: int, most: int, budget: list[int]) -> list[Pattern] | None:
    """A plan of at most `most` sequences, or None. Waste may not exceed what that number leaves over."""
    left = {x: n for x, n in counts.items() if n}
    if not left:
        return []
    spare = most * capacity - sum(x * n for x, n in left.items())
    if spare < 0 or _bound(left, capacity) > most or budget[0] <= 0:
        return None
    longest = max(left)
    left[longest] -= 1
    for _, filling in fillings(left, capacity - longest, FILLINGS, spare):
        budget[0] -= 1
        rest = dict(left)
        for x, n in filling:
            rest[x] -= n
        if (found := _search(rest, capacity, most - 1, budget)) is not None:
            whole = Counter({longest: 1})
            for x, n in filling:
                whole[x] += n
            return [tuple(sorted(whole.items(), reverse=True)), *found]
        if budget[0] <= 0:
            return None
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold counts[x] pieces of each length x."""
    out = _greedy(counts, capacity)
    total = sum(n for _, n in out)
    budget = [NODES]
    if total > lower_bound(counts, capacity):
        tail: list[Pattern] = []
        while out and len(tail) < TAIL:
            pattern, n = out.pop()
            take = min(n, TAIL - len(tail))
            tail += [pattern] * take
            if n > take:
                out.append((pattern, n - take))
        held: Counter[int] = Counter()
        for pattern in tail:
            held.update(dict(pattern))
        while len(tail) > lower_bound(held, capacity) and (better := _search(dict(held), capacity, len(tail) - 1, budget)) is not None:
            tail = better
        out += [(pattern, 1) for pattern in tail]
    return out


class Places:
    """Where the r-th piece of a length stands, for each length and rank.

    Its size has a bound that only the capacity sets. A pattern is used as often as the counts allow, so after it some length x in it
    has fewer pieces left than the pattern takes, and the next pattern that x limits takes fewer of them; it began with capacity / x at
    most. So there are at most the sum of capacity / x over all lengths x of them (35,000 for 4096), and TAIL, each with a few lengths.
    """

    def __init__(self, patterns: list[tuple[Pattern, int]]) -> None:
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        taken: Counter[int] = Counter()
        for pattern, times in patterns:
            offset = 0
            for x, n in pattern:
                by.setdefault(x, []).append((taken[x], n, sequence, offset))
                taken[x] += n * times
                offset += n * x
            sequence += times
        self.by = {x: np.array(rows, np.int64) for x, rows in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            rows = self.by[x]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + nth // row[:, 1]
            offset[at] = row[:, 3] + nth % row[:, 1] * x
        return sequence, offset


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 1, planner: Callable[[dict[int, int], int], list[tuple[Pattern, int]]] = plan) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece. path: a tokenizer
    file that every executor has.

    Texts are read once and not shuffled. What is shuffled are rows of a few numbers a piece; the driver gets one count for each
    length up to capacity.
    """
    cut = saved(pieces(docs, path, capacity, end_id), "pieces")
    counts = saved(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(planner(total, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "task", "before"), "before")
    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = struct_of("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(3).to_numpy()
            sequence, offset = places.value.find(length, b.column(5).to_numpy())
            yield batch_of({"doc_id": b.column(0), "piece": b.column(1), "start": b.column(2), "length": length.astype(np.int64), "ids_crc32": b.column(4), "sequence_id": sequence, "offset": offset}, out)

    return ranked.mapInArrow(run, out)
