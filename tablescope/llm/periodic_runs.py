"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(MIN_WORDS, 3 * q)`` long, that no
neighbouring word extends. The texts of a batch are one sequence of word numbers, and comparisons never leave a text.

1. Doubling gives the rank of every block of 1, 2, 4, ... words among equal blocks of its text, and with the last
   ranks the suffix array. Only blocks that occur again are carried to the next length, so common texts end after a few rounds.
2. A wavelet tree over the suffix array answers range successors: the next occurrence of a
   block at or after a place is the smallest such entry of the block's suffix array interval.
3. For every length L = 8, 16, 32, ... and every block at a multiple of L, its occurrences in the windows beginning
   L to 2L - 1 words later (1 to 15 for L = 8) are queried. A run with period q in [L, 2L) holds such a block and
   the same block q words later, so its period is among the distances. A window has room for L beginnings, so three occurrences
   or more form a progression whose difference d is the period of the block. Such a block lies in a stretch of period d, and
   a run of a longer period must bring the ends of the two stretches together: at most two distances are left, or d itself.
4. A candidate is extended in both directions by ranks of dyadic blocks, largest first, and kept if it is long
   enough. Of equal stretches the smallest period is kept.

Memory: a batch of about a megabyte of text, or one longer text, at four bytes a word for each doubling that finds
repeats. A text is the unit of work, and no rows are exchanged.

Defined results: null and empty texts have no words and no runs; a text without runs is its words joined by single
spaces; words are exact (case counts); repeated rows and ties in doc_id are rows of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import pieces
from tablescope.llm.common import ship

#: A run has at least so many words, and three periods.
MIN_WORDS = 24
#: Words of the shortest blocks that are looked up (a power of two; a run of MIN_WORDS holds a block and its copy).
BLOCK = 8


class Blocks:
    """Ranks of all dyadic blocks (equal rank, equal words), and the suffix array they lead to."""

    def __init__(self, codes: np.ndarray, text: np.ndarray):
        n = len(codes)
        self.n = n
        end = np.searchsorted(text, text, "right")
        _, first = np.unique(text.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
        order = np.argsort(first, kind="stable")
        slot = np.arange(n)
        head = np.maximum.accumulate(np.where(np.r_[True, first[order][1:] != first[order][:-1]], slot, 0)) if n else slot
        rank = np.empty(n, np.int64)
        rank[order] = head
        #: rank of the block of 2**k words at each place: where its interval of the suffix array begins
        self.ranks: list[np.ndarray] = []
        #: places of blocks that occur again, in suffix array order, and how often each occurs
        self.again: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1
        while True:
            groups, place, sizes = np.unique(head, return_inverse=True, return_counts=True)
            more = sizes[place] > 1
            active = order[more]
            self.ranks.append(rank.astype(np.int32))
            self.again.append((active, sizes[place][more]))
            if not len(active):
                break
            after = active + width
            second = np.where(after < end[active], rank[np.minimum(after, n - 1)], -1)
            key = rank[active] * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            order, key = active[by], key[by]
            old = rank[order]
            slot = np.arange(len(order))
            begins = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], slot, 0))
            slot = old + slot - begins
            head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], slot, 0))
            rank[order] = head
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j (i < j) on."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            same = (b < self.n) & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
            a += same << k
            b += same << k
        return a - i

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j (i < j)."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, back = self.ranks[k], a - (1 << k)
            same = (back >= 0) & (rank[np.maximum(back, 0)] == rank[np.maximum(b - (1 << k), 0)])
            a -= same << k
            b -= same << k
        return i - a


class WaveletTree:
    """Order statistics over ranges of an array of distinct numbers, all queries of a batch at once (levels in matrix form)."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~one)]
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.r_[values[~one], values[one]]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many entries of [lo, hi) are less than x."""
        out = np.where(x >> self.bits > 0, hi - lo, 0)
        inside = x >> self.bits == 0
        for bit, zeros, n0 in self.levels:
            one, zl, zh = x >> bit & 1 == 1, zeros[lo], zeros[hi]
            out += np.where(one & inside, zh - zl, 0)
            lo, hi = np.where(one, n0 + lo - zl, zl), np.where(one, n0 + hi - zh, zh)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest entry (from 0) of [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros, n0 in self.levels:
            zl, zh = zeros[lo], zeros[hi]
            one = n >= zh - zl
            n = n - np.where(one, zh - zl, 0)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, n0 + lo - zl, zl), np.where(one, n0 + hi - zh, zh)
        return out

    def successors(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
        """The next ``count`` entries of [lo, hi) from x on, as rows; -1 where there are no more."""
        skip = self.below(lo, hi, x)
        out = np.full((count, len(lo)), -1, np.int64)
        for i in range(count):
            there = np.flatnonzero(skip + i < hi - lo)
            out[i, there] = self.nth(lo[there], hi[there], skip[there] + i)
        return out


def candidates(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): a block begins at ``place`` and again ``period`` words later, for all periods that runs may have."""
    first = BLOCK.bit_length() - 1
    none = np.zeros(0, np.int64)
    if len(blocks.again) <= first or not len(blocks.again[first][0]):
        return none, none
    # the suffix array of the places that matter: those whose block of eight words occurs again
    suffixes = blocks.again[first][0]
    suffixes = suffixes[np.argsort(blocks.ranks[-1][suffixes], kind="stable")]
    slots = blocks.ranks[-1][suffixes]
    places = np.sort(suffixes)
    tree = WaveletTree(np.searchsorted(places, suffixes))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(first, len(blocks.again)):
        size = 1 << k
        at, times = blocks.again[k]
        whole = at % size == 0
        at, times = at[whole], times[whole]
        lo = np.searchsorted(slots, blocks.ranks[k][at])
        windows = [(1, size), (size + 1, 2 * size - 1)] if k == first else [(size, 2 * size - 1)]
        for nearest, farthest in windows:
            next_ = tree.successors(lo, lo + times, np.searchsorted(places, at + nearest), 3)
            seen = np.where(next_ >= 0, places[next_], np.iinfo(np.int64).max)
            inside = seen <= at + farthest
            few = inside.sum(axis=0) < 3
            for i in range(2):
                take = few & inside[i]
                found.append((at[take], seen[i][take] - at[take]))
            # a progression: the block has the period that its occurrences are apart
            b, o = at[~few], seen[0][~few]
            d = seen[1][~few] - o
            end0, end1 = b + d + blocks.forward(b, b + d), o + d + blocks.forward(o, o + d)
            start0, start1 = b - blocks.backward(b, b + d), o - blocks.backward(o, o + d)
            one = end0 == end1
            if k == first:
                found.append((b[one], d[one]))
            for q in ((end1 - end0)[~one], (start1 - start0)[~one]):
                fits = (q >= nearest) & (q <= farthest)
                found.append((b[~one][fits], q[fits]))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(codes: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs, in order of start and period (places count over all texts)."""
    blocks = Blocks(codes, text)
    at, period = candidates(blocks)
    start = at - blocks.backward(at, at + period)
    length = at + period + blocks.forward(at, at + period) - start
    long = length >= np.maximum(min_words, 3 * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, ends].astype(np.int32))


def find_in_batch(batch: pa.RecordBatch, min_words: int = MIN_WORDS) -> pa.RecordBatch:
    """doc_id, n_words, runs and the text without repeated periods, of one batch of (doc_id, text)."""
    texts = batch.column("text")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    flat, text = flat.filter(full), text[full.to_numpy(zero_copy_only=False)]
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.searchsorted(text, np.arange(len(texts)), "right")
    begins = np.r_[0, ends[:-1]]
    start, length, period = runs_of(codes, text, min_words)
    of = text[start]
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    left = flat.filter(pa.array(kept))
    kept_ends = np.searchsorted(text[kept], np.arange(len(texts)), "right")
    collapsed = pc.binary_join(pa.ListArray.from_arrays(_offsets(kept_ends), left), " ")
    items = pa.StructArray.from_arrays([pa.array(x) for x in (start - begins[of], length, period)], fields=list(RUN))
    runs = pa.ListArray.from_arrays(_offsets(np.searchsorted(of, np.arange(len(texts)), "right")), items)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - begins), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; in words from 0), collapsed (the text that is left).

    A word goes if a run holds it after its first period; the rest is joined by single spaces.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"runs of less than {MIN_WORDS} words may hold no whole block and its copy")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield find_in_batch(part, min_words)

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return clean.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals. Null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period, exponent_milli, and digests of all runs and of the text left."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
