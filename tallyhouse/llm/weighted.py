"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), and a text's likeness to an edited one and to the next.

A text's terms are its runs of five words, A-Z folded, hashed to 64 bits, each weighted by how often it occurs; a text of
fewer words is one term. For each of SAMPLES samples a term draws r and c from Gamma(2, 1) and b from the unit interval,
by its hash alone. With t = floor(ln(weight) / r + b) its rank is ln(c) - r (t - b + 1), and the term of the least rank,
with its t, is the sample. Two texts draw the same sample with the generalised Jaccard similarity of their weights: the
sum of the smaller weights over that of the larger ones. A fingerprint holds 16 bits of each sample, and the likeness of
two is the share of equal samples, so that its standard error is 0.0625 at most, and 1 / 65536 of unequal ones agree.

Gamma variates come from their inverse distribution at the middles of 65,536 equal steps; b has 24 bits.

Nulls and odd rows: a null or blank text has no terms, and its samples are all zero: blank texts are wholly alike. Equal
texts have equal fingerprints. Very long texts are handled one at a time, their terms in blocks. Extra columns are kept
by with_fingerprint() and compared() returns only what it is asked to keep. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tallyhouse.llm.common import Scratch, whole
from tallyhouse.llm.simhash import FOLD

SAMPLES, SHINGLE, STEPS = 64, 5, 1 << 16
BLOCK = 1024
ODDS = 6
#: Code points of short texts that are drawn for in one go.
LOT = 1 << 16
#: More than rounding can change in a rank.
SLACK = np.float32(0.001)
DIGITS = 4 * SAMPLES
_RNG = np.random.default_rng(11)
_SEEDS = _RNG.integers(0, 1 << 64, (SAMPLES, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
_MIX, _LAST = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_U32 = np.uint64(32)


def _gamma() -> np.ndarray:
    """Gamma(2, 1) at STEPS quantiles: solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        under = -np.expm1(-x) - x * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


GAMMA = _gamma().astype(np.float32)
LOG_GAMMA = np.array([math.log(x) for x in GAMMA.tolist()], np.float32)


#: For the upper 6, 6 and 4 bits of the places of c and r in GAMMA and of b: a rank that no term of weight one falls below.
LEAST = (LOG_GAMMA[::1024, None, None] - GAMMA[1023::1024, None] * (1 - np.arange(16, dtype=np.float32) / 16)).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a hash mixed; the upper ones are the best."""
    x = x * _MIX
    x ^= x >> _U32
    x *= _LAST
    return x


def hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """A hash of each word of each text; a word that is there many times is hashed once."""
    known = dict.fromkeys(chain.from_iterable(texts))
    of = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    for i, w in enumerate(known):
        known[w] = i
    return [of[np.array(list(map(known.__getitem__, words)), np.int64)] for words in texts]


def terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes, sorted, and their counts, of the hashes of a text's words."""
    size = min(len(words), SHINGLE)
    n = len(words) - size + 1
    if not size:
        return words, np.zeros(0, np.int64)
    found = words[:n] * _ODD[0]
    for i in range(1, size):
        found += words[i : i + n] * _ODD[i]
    found = _mixed(found + np.uint64(size))
    found.sort()
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return found[first], np.diff(first, append=n)


#: Of draws: the rank, term and t of each sample (a row) of each set of terms (a column).
Draws = tuple[np.ndarray, np.ndarray, np.ndarray]


def nothing(sets: int) -> Draws:
    return np.full((SAMPLES, sets), np.inf, np.float32), np.zeros((SAMPLES, sets), np.uint64), np.zeros((SAMPLES, sets), np.float32)


def lesser(a: Draws, b: Draws) -> Draws:
    """Of two draws the lesser rank of each sample, at equal ranks the smaller term."""
    first = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
    return tuple(np.where(first, x, y) for x, y in zip(a, b, strict=True))


def _ranks(bits: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and t of terms by their bits (upper parts as in LEAST, then 10 and 10 of c and r and 20 of b) and the logarithms of their weights."""
    field = lambda at, size: (bits >> np.uint64(at)).astype(np.int64) & ((1 << size) - 1)
    r = GAMMA[field(52, 6) << 10 | field(28, 10)]
    b = (field(48, 4) << 20 | field(8, 20)).astype(np.float32) * np.float32(2.0**-24)
    t = np.floor(log / r + b)
    return LOG_GAMMA[field(58, 6) << 10 | field(38, 10)] - r * (t - b + np.float32(1)), t


def draw(sets: list[tuple[np.ndarray, np.ndarray]]) -> Draws:
    """The draws of sets of distinct terms, each sorted, with their counts.

    The least of the ranks of a set is exponentially distributed about the inverse of its weight, so that it seldom
    exceeds ODDS times that. Only terms that may rank below this bar are ranked, and the heavier ones; where none does,
    all terms of the set are ranked for the sample.
    """
    best = nothing(len(sets))
    sizes = [len(t) for t, _ in sets]
    if not sum(sizes):
        return best
    term, count = np.concatenate([t for t, _ in sets]), np.concatenate([c for _, c in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    logs = np.zeros(len(term), np.float32)
    heavy = np.flatnonzero(count > 1)
    logs[heavy] = [math.log(c) for c in count[heavy].tolist()]
    for at in range(0, len(term), BLOCK):
        some, log, own = term[at : at + BLOCK], logs[at : at + BLOCK], owner[at : at + BLOCK]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lengths = np.diff(starts, append=len(some))
        bar = np.log(ODDS / np.add.reduceat(count[at : at + BLOCK], starts)).astype(np.float32)
        bits = _mixed(some[None, :] ^ _SEEDS)
        least = LEAST.take((bits >> np.uint64(48)).view(np.int64), mode="clip")
        least[:, np.flatnonzero(log > 0)] = -np.inf
        got, here = nothing(len(starts)), own[starts]
        _place(got, np.flatnonzero(least <= np.repeat(bar + SLACK, lengths)), bits, some, log, starts)
        row, column = np.nonzero(got[0] > bar)
        if len(row):
            every = np.repeat(row * len(some) + starts[column], lengths[column]) + np.arange(lengths[column].sum()) - np.repeat(np.cumsum(lengths[column]) - lengths[column], lengths[column])
            _place(got, every, bits, some, log, starts)
        for full, part in zip(best, lesser(tuple(x[:, here] for x in best), got), strict=True):
            full[:, here] = part
    return best


def _place(got: Draws, flat: np.ndarray, bits: np.ndarray, some: np.ndarray, log: np.ndarray, starts: np.ndarray) -> None:
    """Put the least rank among these places of bits, by sample and set, with its term and t."""
    if not len(flat):
        return
    row, col = np.divmod(flat, len(some))
    rank, t = _ranks(bits.ravel()[flat], log[col])
    group = row * len(starts) + np.searchsorted(starts, col, "right") - 1
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    won = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, heads), np.diff(heads, append=len(rank))))
    won = won[np.append(True, group[won[1:]] != group[won[:-1]])]
    for full, part in zip(got, (rank, some[col], t), strict=True):
        full.ravel()[group[won]] = part[won]


def samples(drawn: Draws) -> np.ndarray:
    """16 bits of each sample's term and t: a row for each set."""
    rank, term, t = drawn
    found = _mixed(term ^ _mixed(t.astype(np.int64).view(np.uint64) + _ODD[0])) >> np.uint64(48)
    return np.where(np.isinf(rank), 0, found).astype(np.uint16).T


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A row of samples for each text."""
    return samples(draw(list(map(terms, hashes([words_of(t or "") for t in texts])))))


def two_fingerprints(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The samples of the texts of each pair, which share much: what both have as often is drawn once."""
    sets = []
    found = list(map(terms, hashes([words_of(t) for pair in pairs for t in pair])))
    for (a, m), (b, n) in zip(found[::2], found[1::2], strict=True):
        at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
        same = (b[at] == a) & (n[at] == m) if len(b) else np.zeros(len(a), bool)
        rest = np.ones(len(b), bool)
        rest[at[same]] = False
        sets += [(a[~same], m[~same]), (a[same], m[same]), (b[rest], n[rest])]
    drawn = draw(sets)
    one, both, two = (tuple(x[:, i::3] for x in drawn) for i in range(3))
    return samples(lesser(both, one)), samples(lesser(both, two))


def lots(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts, some at a time: few enough to bear, enough to make arrays worth while."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= LOT:
            yield some
            some, size = [], 0
    if some:
        yield some


def written(found: np.ndarray) -> bytes:
    return found.astype(">u2").tobytes()


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint: four hex digits a sample."""

    @F.pandas_udf("binary")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([written(f) for some in lots(texts) for f in fingerprints(some)], dtype=object)

    return docs.withColumn(name, F.lower(F.hex(found(F.col(text)))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(SAMPLES))


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _like(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def compared(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with the next by descending key (nulls last; after the last the first).

    Texts of one key follow one another by a hash. Returns the key, n_chars, edited_sha256 (of the text as edited() makes
    it), fingerprint and edited_fingerprint, and near_edited and near_next: likeness to the edited and to the next text.

    Texts are shuffled once, into ranges of keys sorted in place. A task compares each with its successor as they pass;
    the first and last text of each range, two rows a task, are written beside the results and meet afterwards.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")).withColumns({"_h": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    order = [F.col("key").desc_nulls_last(), F.col("_h"), F.col("_at")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part"))
    result = f"key {rows.schema['key'].dataType.simpleString()}, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    made = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    edges = made.append(pa.field("part", pa.int32())).append(pa.field("first", pa.bool_())).append(pa.field("text", pa.string()))

    def against(rows: list[tuple]) -> list[tuple[list, np.ndarray]]:
        """For (key, text, following) each: a result but for its likeness to the following, and the text's samples."""
        others = [edited(t, following) for _, t, following in rows]
        own, changed = two_fingerprints([(t, o) for (_, t, _), o in zip(rows, others, strict=True)])
        digest = [hashlib.sha256(o.encode("utf-8", "surrogatepass")).digest() for o in others]
        return [([key, len(t), d, written(a), written(b), _like(a, b)], a) for (key, t, _), d, a, b in zip(rows, digest, own, changed, strict=True)]

    def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def passing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = waiting = None  # the first text, the last one, and the result that wants the last one's samples

        def results(rows: list[tuple]) -> Iterator[list]:
            nonlocal waiting
            for found, own in against(rows):
                if waiting is not None:
                    yield [*waiting[0], _like(waiting[1], own), None, None, None]
                waiting = found, own

        for part in parts:
            keys, texts, place = (part.column(i).to_pylist() for i in range(3))
            out, at = [], 0
            for some in lots(texts):
                rows = list(zip(keys[at : at + len(some)], some, place[at : at + len(some)], strict=True))
                first, row = first or rows[0], ([held] if held else []) + rows
                out += results([(a[0], a[1], b[1]) for a, b in pairwise(row)])
                held, at = rows[-1], at + len(some)
            yield batch(out, edges)
        if held is not None:
            out = [[row[0], *[None] * 6, row[2], start, row[1]] for row, start in ((first, True), (held, False))]
            if waiting is not None:
                out.append([*waiting[0], _like(waiting[1], fingerprints([held[1]])[0]), None, None, None])
            yield batch(out, edges)

    def meeting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                ((found, own),) = against([row])
                out.append([*found, _like(own, fingerprints([row[2]])[0])])
            yield batch(out, made)

    done = scratch.keep(ranged.mapInArrow(passing, f"{result}, part int, first boolean, text string"))
    heads = done.where("first").select("part", F.col("text").alias("following"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("part"))
    last = done.where("not first").select("key", "text", F.col("part").alias("at")).join(after, "at").join(heads, "part").select("key", "text", "following")
    both = done.where("first is null").select(*made.names).unionByName(last.mapInArrow(meeting, result))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select(F.col("key").alias(key), "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
