"""Periodic runs of words, found with an enhanced suffix array.

Method. The words of a batch of texts are laid out one after another, each text ended by a mark of its own, and their suffixes sorted by
doubling: ranks by 2, 4, 8 ... words, of which only groups that are still tied are sorted again. The ranks of all lengths are kept; the
longest common prefix of two suffixes, and how far two places agree backwards, are read from them. LCP intervals are taken without a
tree: each place of the LCP array splits its interval in two (places of equal LCP one after another), and a stack finds the two parts.
Of the smaller part each suffix i is tested: a branching tandem repeat of period `depth` begins at i if ISA[i + depth] lies in the
other part, and at i - depth if ISA[i - depth] does. Two suffixes are parted at one place only, so every tandem that can't be shifted
right is found once, and a suffix is in the smaller part log2(n) times at most. A tandem is rotated to the left as far as its words
allow; tandems of one stretch (of a period and of its multiples) are one run, whose period is the least.

A run of at least `least` words with a period under least // 4 + 1 also has a multiple of it between that and least / 2, so intervals
of less depth are not looked at: the period is then reduced to its smallest divisor that fits. That leaves out the many chance
repeats of a few words.

Texts are taken whole, whatever their length, each by itself; a batch of texts and its ranks are what a task holds. Null texts stay
null, without runs; texts without words become empty. Rows are independent, so nulls in other columns, ties and repeated rows need
no care; no rows give no rows. Other columns pass unchanged; columns named text and runs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.llm.common import task_of

#: Words and repeats that a run has at least.
LEAST, TIMES = 24, 3
#: Words of texts that are sorted together; a longer text is sorted alone.
TOGETHER = 1 << 19
#: Suffixes of smaller parts that are tested at once.
TESTS = 1 << 21

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Suffixes:
    """The sorted suffixes of several texts. codes: the words of all texts as numbers from 1 on, 0 after each text; text: which text each
    place is of."""

    def __init__(self, codes: np.ndarray, text: np.ndarray) -> None:
        n = len(codes)
        self.codes, self.text = codes, text
        following = np.append(codes[1:], 0)
        following[codes == 0] = 0
        size = int(codes.max(initial=0)) + 1
        key = (text * size + codes) * size + following
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        tied = self._place(rank, order, key[order], np.arange(n))
        #: Of 2, 4, 8 ... words the rank of what begins at each place; equal where the words are, in one text.
        self.ranks = [rank]
        while len(tied):
            h = 1 << len(self.ranks)
            last, rank = rank, rank.copy()
            at = order[tied]
            key = last[at] * n + last[at + h]
            by = np.argsort(key)
            order[tied] = at[by]
            tied = self._place(rank, order[tied], key[by], tied)
            self.ranks.append(rank)
        self.order = order

    @staticmethod
    def _place(rank: np.ndarray, suffixes: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Ranks the sorted suffixes by the slot of the first with their key; returns the slots of those whose key isn't theirs alone."""
        if not len(keys):
            return slots
        first = np.append(True, keys[1:] != keys[:-1])
        rank[suffixes] = slots[first][np.cumsum(first) - 1]
        return slots[~(first & np.append(first[1:], True))]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and b on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks), -1, -1):
            x, y = a + out, b + out
            same = self.ranks[k - 1][x] == self.ranks[k - 1][y] if k else (self.codes[x] == self.codes[y]) & (self.codes[x] > 0)
            out[same] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and b, places of one text."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks), -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = x >= 0
            x, y = np.maximum(x, 0), np.maximum(y, 0)
            inside &= self.text[x] == self.text[a]
            same = inside & (self.ranks[k - 1][x] == self.ranks[k - 1][y] if k else self.codes[x] == self.codes[y])
            out[same] += 1 << k
        return out


def parts(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place of an LCP array: where the part to its left begins and the part to its right ends."""
    values = lcp.tolist()
    left, right, stack = [0] * len(values), [len(values)] * len(values), []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def tandems(s: Suffixes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats whose period is at least depth."""
    none = np.zeros(0, np.int64)
    known = max(0, depth.bit_length() - 2)  # the longest of the ranks that isn't longer than depth
    if known >= len(s.ranks) or len(s.order) < 2:
        return none, none
    a, b = s.order[:-1], s.order[1:]
    maybe = np.flatnonzero(s.ranks[known][a] == s.ranks[known][b]) if depth > 1 else np.arange(len(a))
    lcp = np.zeros(len(s.order), np.int64)
    lcp[maybe + 1] = s.ahead(a[maybe], b[maybe])
    deep = lcp >= depth
    slots = np.flatnonzero(deep | np.append(deep[1:], False))  # suffixes of some interval of that depth
    own, suffix = np.where(deep[slots], lcp[slots], 0), s.order[slots]
    place = np.full(len(s.order) + 1, -1, np.int64)  # the inverse; the last entry stands for places outside
    place[suffix] = np.arange(len(slots))
    left, right = parts(own)
    split = np.flatnonzero(own)
    smaller_left = split - left[split] <= right[split] - split
    begin = np.where(smaller_left, left[split], split)
    size = np.where(smaller_left, split - left[split], right[split] - split)
    low, high = np.where(smaller_left, split, left[split]), np.where(smaller_left, right[split], split)  # the other part
    starts, periods, total = [], [], np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(TESTS, int(total[-1]) if len(total) else 0, TESTS))
    for some in np.split(np.arange(len(split)), np.unique(cuts)):
        n = size[some]
        i = suffix[np.repeat(begin[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))]
        at = np.repeat(some, n)
        q = own[split[at]]
        for first, other in ((i, i + q), (i - q, i - q)):
            there = place[np.where((other >= 0) & (other < len(s.order)), other, -1)]
            hit = (there >= low[at]) & (there < high[at])
            starts.append(first[hit])
            periods.append(q[hit])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (none, none)


def runs(codes: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, ordered by start and period."""
    depth = max(1, least // 4 + 1)
    s = Suffixes(codes, text)
    i, q = tandems(s, depth)
    end = i + 2 * q
    start = i - s.behind(i, i + q)
    long = end - start >= least
    start, end, q = start[long], end[long], q[long]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, q = start[first], end[first], q[first]
    for d in range(depth - 1, 0, -1):  # the smallest divisor that is a period comes last
        at = np.flatnonzero((q % d == 0) & (q < 2 * depth))
        if len(at):
            steps = start[at, None] + np.arange(2 * depth)
            at = at[((codes[steps % len(codes)] == codes[(steps + d) % len(codes)]) | (np.arange(2 * depth) >= q[at, None])).all(axis=1)]
            q[at] = d
    kept = end - start >= times * q
    start, end, q = start[kept], end[kept], q[kept]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs (text, any others). Returns its columns, and runs array<struct<start, length, period>>: all maximal stretches of at least `least`
    words, and of at least `times` (two or more) of their smallest period, by start and period; words are numbered from 0. Of text those words stay that are
    in no run or within the first period of every run that holds them, joined by single spaces."""
    rest = [c for c in docs.columns if c not in ("text", "runs")]
    rows = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string"))
    fields = rows.schema["rest"].dataType.fields[1:]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("runs", RUNS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("repeats")
        for b in batches:
            found = pc.ascii_split_whitespace(pc.fill_null(b.column(1), ""))
            words, offsets = found.flatten(), found.offsets.to_numpy().astype(np.int64)
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(real))[offsets - offsets[0]]
            words = words.filter(pa.array(real)).dictionary_encode()
            ids, n = words.indices.to_numpy().astype(np.int64), np.diff(offsets)
            change, spans, at = np.zeros(len(ids) + 1, np.int64), [], 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
                codes = np.insert(ids[offsets[at] : offsets[to]] + 1, offsets[at + 1 : to + 1] - offsets[at], 0)
                own = np.repeat(np.arange(to - at), n[at:to] + 1)
                start, end, q = runs(codes, own, least, times)
                doc = own[start] + at if len(start) else start
                start, end = start - own[start] + offsets[at], end - own[start] + offsets[at]  # without the marks
                np.add.at(change, start + q, 1)
                np.add.at(change, end, -1)
                spans.append(np.stack([doc, start - offsets[doc], end - start, q], axis=1))
                at = to
            kept = np.cumsum(change)[:-1] == 0
            values = words.filter(pa.array(kept)).dictionary_decode() if len(ids) else pa.array([], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[offsets], pa.int32()), values)
            joined = pc.if_else(b.column(1).is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))
            spans = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
            each = pa.StructArray.from_arrays([pa.array(spans[:, k + 1]) for k in range(3)], names=["start", "length", "period"])
            own = pa.ListArray.from_arrays(pa.array(np.searchsorted(spans[:, 0], np.arange(b.num_rows + 1)), pa.int32()), each)
            columns = b.column(0).flatten()[1:]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), joined, own.cast(arrow.field(len(arrow) - 1).type)], schema=arrow)

    return rows.mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in docs.columns if c != "runs"), "runs")
