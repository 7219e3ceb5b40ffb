"""Runs of repeated word sequences, by the linear tandem-repeat method of Gusfield and Stoye (2004).

A run is a stretch of words with smallest period q, four times the period and six words long at least, that no word
beside it extends. Tandem repeats (a sequence of q words twice in a row) are found per text in three steps:

1. Lempel-Ziv blocks, each the longest piece that has begun earlier. The second half of the leftmost occurrence of a
   tandem repeat ends in its centre's block or the next one. For every block and half length, extensions forwards and
   backwards from the block's ends give pairs (start, half length) that cover the leftmost occurrence of every type.
2. From the place of each pair in the suffix tree, suffix links lead to the next rotation as long as the tree has one,
   whichever occurrence it is of, until a place that is marked already. Then all types are marked: the vocabulary.
3. The leaves below a marked place are the occurrences of a type. Occurrences with the same half length that start at
   words in a row merge into one run.

The suffix tree is held as suffix array and common prefixes: a node is an interval of suffixes, the suffix link of the
interval about suffix i is that about suffix i + 1, and a child is found by bisection. Ranks of sequences of 1, 2, 4, ...
words, from which the array is sorted, also answer how far two places agree. Only tandem repeats that are no repetition
of something shorter are followed, so that n words have at most n log n occurrences and periods are smallest ones.

Nulls and odd rows: a null or blank text has no runs. Repeated rows are searched each. Very long texts are handled one
at a time, in memory that goes with words times the logarithm of the longest repeat. Extra columns are kept; those named
like a result are replaced. An empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
#: Words of short texts that are searched in one go.
MANY = 1 << 15
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Words:
    """The codes of words (from 1, gapless) with what the three steps ask of them.

    Several texts may be put together, if each has codes of its own: then nothing agrees across texts.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.n = n = len(codes)
        count = np.bincount(codes, minlength=1)
        rank = np.append((np.cumsum(count) - count)[codes] + 1, 0)  # places with smaller words, plus one; the end is 0
        self.levels = []  # ranks by the next 1, 2, 4, ... words, while any sequence of so many is there twice
        self.pairs = np.zeros(0, np.int64)  # places of sequences of two words that are there twice
        open_, step = np.flatnonzero(count[codes] > 1), 1
        while len(open_):
            self.levels.append(rank)
            key = rank[open_] * (n + 2) + rank[np.minimum(open_ + step, n)]
            order = np.argsort(key)
            at, key = open_[order], key[order]
            place = np.arange(len(at))
            fresh = np.append(True, key[1:] != key[:-1])
            outer = np.append(True, rank[at[1:]] != rank[at[:-1]])
            rank = rank.copy()
            rank[at] += np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
            open_ = at[~(fresh & np.append(fresh[1:], True))]
            if step == 1:
                self.pairs = open_
            step *= 2
        self.codes, self.rank = np.append(codes, 0), rank[:n] - 1
        self.array = np.empty(n, np.int64)
        self.array[self.rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and b on (a and b differ)."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            got += (self.levels[j][a + got] == self.levels[j][b + got]).astype(np.int64) << j
        return got

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and b."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = a - got - (1 << j), b - got - (1 << j)
            inside = np.minimum(x, y) >= 0
            got += (inside & (self.levels[j][np.where(inside, x, 0)] == self.levels[j][np.where(inside, y, 0)])).astype(np.int64) << j
        return got

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks.

        The longest earlier match of a place is with the nearest suffix, on either side of it in the array, that starts
        earlier. Blocks of two words or more begin at sequences of two words that are there twice; only these are asked.
        """
        at = self.array[np.sort(self.rank[self.pairs])]
        before, after, open_ = dict.fromkeys(at.tolist(), -1), dict.fromkeys(at.tolist(), -1), []
        for p in at.tolist():
            while open_ and open_[-1] > p:
                after[open_.pop()] = p
            if open_:
                before[p] = open_[-1]
            open_.append(p)
        size = np.ones(len(at), np.int64)
        for side in (before, after):
            other = np.fromiter(side.values(), np.int64, len(at))
            on = np.flatnonzero(other >= 0)
            size[on] = np.maximum(size[on], self.ahead(at[on], other[on]))
        starts, end = np.ones(self.n, bool), 0
        longer = np.flatnonzero(size > 1)
        for p, length in sorted(zip(at[longer].tolist(), size[longer].tolist(), strict=True)):
            if p >= end:
                end = p + length
                starts[p + 1 : end] = False
        return np.flatnonzero(starts)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, half length) pairs covering the leftmost occurrence of every tandem repeat that is no shorter one's repetition."""
        h = self.blocks()
        stop = np.append(h[1:], self.n)
        size = stop - h
        wide = size + np.append(size[1:], 0)

        def each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

        # the centre and the left end in a block, the right end beyond it: the next block's first word is in the second half
        b, k = each(size[:-1])
        at = stop[b]
        on = self.codes[at] == self.codes[at - k]
        at, k = at[on], k[on]
        q = at - k
        first, more = self.back(at, q), self.ahead(at, q)
        on = first + more >= k
        starts, halves = [np.maximum(q - first, q - k + 1)[on]], [k[on]]
        # the left end before a block, the centre in it or at its start: the word before the block is in the first half
        b, k = each(np.where(h > 0, np.minimum(wide, self.n - h), 0))
        at = h[b]
        on = self.codes[at - 1] == self.codes[at + k - 1]
        at, k = at[on], k[on]
        first, more = self.back(at, at + k), self.ahead(at, at + k)
        on = first + more >= k
        starts.append(np.maximum(at - first, at - k)[on])
        halves.append(k[on])
        start, half = np.concatenate(starts), np.concatenate(halves)
        return self._primitive(start, half)

    def _primitive(self, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 2
        while len(half) and p <= half.max():
            if all(p % d for d in range(2, int(p**0.5) + 1)):
                at = np.flatnonzero(half % p == 0)
                d = half[at] // p
                keep = np.ones(len(half), bool)
                keep[at] = self.ahead(start[at], start[at] + d) < half[at] - d
                start, half = start[keep], half[keep]
            p += 1
        return start, half

    def runs(self, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period."""
        if not self.levels:
            return []
        start, half = self.squares()
        if not len(half):
            return []
        common = np.append(0, self.ahead(self.array[1:], self.array[:-1]))
        found, order = [], np.lexsort((start, half))
        start, half = start[order], half[order]
        on = self.ahead(start, start + half) - half
        for k in np.unique(half).tolist():
            node = np.cumsum(common < 2 * k) - 1  # of every suffix, its interval of those with the same 2 k words
            marked = np.zeros(node[-1] + 1, bool)
            some = slice(np.searchsorted(half, k), np.searchsorted(half, k, "right"))
            for p, more in zip(start[some].tolist(), on[some].tolist(), strict=True):
                self._walk(p, k, more, node, marked, common)
            at = np.sort(self.array[marked[node]])
            cut = np.flatnonzero(np.diff(at) > 1)
            low, high = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
            found += [(s, e - s + 2 * k, k) for s, e in zip(low.tolist(), high.tolist(), strict=True) if e - s + 2 * k >= max(least, times * k)]
        return sorted((s, n, q) for s, n, q in found)

    def _walk(self, p: int, k: int, on: int, node: np.ndarray, marked: np.ndarray, common: np.ndarray) -> None:
        """Mark the tandem repeat at p, after which ``on`` words go on with its period, and the rotations that suffix links lead to."""
        while not marked[node[self.rank[p]]]:
            # where the text itself goes on, the rotations lie at the next places; after k of them all are known
            on = min(on, k - 1)
            nodes = node[self.rank[p : p + on + 1]]
            known = np.flatnonzero(marked[nodes])
            if len(known):
                marked[nodes[: known[0]]] = True
                return
            marked[nodes] = True
            if on == k - 1:
                return
            # the suffix link of the last one, and there the child of the word that would close the next rotation
            last = p + on
            r = self.rank[last + 1]
            edge = np.flatnonzero(common < 2 * k - 1)
            i = np.searchsorted(edge, r, "right")
            low, high = int(edge[i - 1]), int(edge[i]) if i < len(edge) else self.n
            after = self.codes[self.array[low:high] + 2 * k - 1]
            c = low + int(np.searchsorted(after, self.codes[last]))
            if c == high or after[c - low] != self.codes[last]:
                return
            p = int(self.array[c])
            on = int(self.ahead(np.array([p]), np.array([p + k]))[0]) - k


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each text's words: (start, length, period) of every run, by start, then period."""
    codes, first, total, found = [], [0], 0, [[] for _ in texts]
    for words in texts:
        known = dict.fromkeys(words)
        for total, w in enumerate(known, total + 1):  # noqa: B020
            known[w] = total
        codes += map(known.__getitem__, words)
        first.append(len(codes))
    if not codes:
        return found
    every = Words(np.array(codes)).runs(least, times)
    owner = np.searchsorted(first, [s for s, _, _ in every], "right") - 1
    for (s, n, q), t in zip(every, owner.tolist(), strict=True):
        found[t].append((s - first[t], n, q))
    return found


def pieces(texts: Iterable[str | None], least: int = MANY) -> Iterator[list[list[bytes]]]:
    """Words of texts, some texts at a time: few enough to bear, enough to make arrays worth while."""
    some, size = [], 0
    for t in texts:
        some.append((t or "").encode("utf-8", "surrogatepass").split())
        size += len(some[-1])
        if size >= least:
            yield some
            some, size = [], 0
    if some:
        yield some


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join(compress(words, keep.tolist()) if runs else words).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with ``runs`` (start, length, period) by start, then period, and ``collapsed``: the words with only the first period of each run, joined by a space."""

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for texts in pieces(part):
                for words, runs in zip(texts, runs_of(texts, least, times), strict=True):
                    rows.append(([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], _collapsed(words, runs)))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    # called once a row, whatever is made of its results: Spark merges no later projection with it
    return docs.withColumn("_found", found.asNondeterministic()(F.col(text))).withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")
