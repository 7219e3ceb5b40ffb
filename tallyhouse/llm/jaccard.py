"""Near-duplicates by exact Jaccard similarity of word shingles, with MinHash bands for candidates.

A text's shingles are its runs of five words, A-Z folded, hashed to 64 bits. Sixteen bands of four minima each find
a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 4) ** 16, over 0.9998; every candidate is then held against
the bar by its whole shingle sets, so that no pair under it is linked.

Members of a bucket first meet leads: all meet the smallest, those that are not its likes meet the smallest among
themselves, and so on for ``leads`` rounds. A round costs the size of what is left, so that a large group of copies
costs its size, not its square. Components over these links and the ``known`` ones settle most buckets. The members of
every bucket that still holds two components then meet by exact prefix filtering: with the shingles of each text
ordered by rarity, a pair at the bar shares one among the first ninth of the smaller set and the first fifth of the
larger one (Chaudhuri et al., 2006; Bayardo et al., 2007). Passages that many texts share are frequent and so come
last; only pairs near the bar are left to compare. So no pair that shares a bucket is lost, whatever ``leads`` is.

Near copies just under the bar share these shingles all the same. Each text therefore has a sketch: for each of 1,024
places of a hash, whether an odd number of its shingles falls there. A shingle that only one of two texts has changes
one place, so that texts whose sketches differ in more places than the bar allows shingles are under it (Sandes et al.,
2017), and the join turns them away where they meet. To reject them two by two takes the square of such a group, within
the join and without a row made; a shingle of many texts is dealt over several keys, so that no task meets them all.

Nulls and odd rows: a null or blank text has no shingles, and all of them are one node. A text of fewer words than a
shingle is one shingle. Copies are one node. Extra columns are kept.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import SPACES, Scratch, lower_ascii, whole
from tallyhouse.llm.components import connected_components
from tallyhouse.llm.simhash import FOLD

BANDS, ROWS = 16, 4
#: Keeps products such as 0.8 * 5 from rounding past a whole number.
EPS = 1e-9
#: Bits of a sketch, a power of two, and so many texts of one shingle meet the others by one key.
SKETCH, SHARE = 1024, 2000
_RNG = np.random.default_rng(7)
FLIP, ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64), _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = list(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(11)), np.uint64, len(parts)))


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    low = np.array([((found ^ f) * m).min() for f, m in zip(FLIP, ODD, strict=True)], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(low)]


def node(text: str = "text") -> Column:
    body = lower_ascii(whole(F.col(text)))
    return F.xxhash64(F.when(F.btrim(body, F.lit(SPACES)) == "", "").otherwise(body))


def _prefixes(sets: DataFrame, bar: float) -> DataFrame:
    """sets: node, c and set. A row for each shingle among the first 1 - bar of its set by rarity, with its place."""
    rows = sets.select("node", "c", F.size("set").alias("n"), F.explode("set").alias("sh"))
    often = rows.groupBy("sh").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("node").orderBy("often", "sh")
    placed = rows.join(often, "sh").withColumn("at", F.row_number().over(rare) - 1)
    return placed.where((F.col("often") > 1) & (F.col("at") <= F.col("n") - F.ceil(bar * F.col("n") - EPS))).drop("often")


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each value of a hash's first bits: whether an odd number of hashes has it; as longs."""
    first = found.view(np.uint64) >> np.uint64(65 - SKETCH.bit_length())
    return np.packbits((np.bincount(first.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def candidates(sets: DataFrame, scratch: Scratch, bar: float) -> DataFrame:
    """sets: node, component c and set. Pairs (a, b) of different components; all at the bar or more are among them."""

    @F.pandas_udf("array<bigint>")
    def sketches(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in some:
            yield pd.Series([sketch(np.asarray(f, np.int64)) for f in found])

    bits = [f"bits{i}" for i in range(SKETCH // 64)]
    drawn = sets.select("node", sketches("set").alias("drawn")).select("node", *[F.get("drawn", F.lit(i)).alias(b) for i, b in enumerate(bits)])
    rows = scratch.keep(_prefixes(sets, bar).join(drawn, "node"))
    least = 2 * bar / (1 + bar)
    many = F.broadcast(rows.groupBy("sh").agg(F.ceil(F.count("*") / SHARE).alias("deals")).where("deals > 1"))
    dealt = rows.join(many, "sh", "left").withColumn("deals", F.coalesce("deals", F.lit(1).cast("long")))
    own = ["node", "c", "n", "at", *bits]
    x = dealt.where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - EPS)).select("sh", F.pmod("node", "deals").alias("deal"), *[F.col(c).alias(f"x_{c}") for c in own])
    y = dealt.select("sh", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"y_{c}") for c in own])
    apart = (F.col("x_c") != F.col("y_c")) & (F.struct("x_n", "x_node") < F.struct("y_n", "y_node"))
    sized = F.col("x_n") >= bar * F.col("y_n") - EPS
    # what can follow a common shingle at these places must do for the overlap that the bar asks for
    enough = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= least / 2 * (F.col("x_n") + F.col("y_n")) - EPS
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits])
    alike = differ <= (1 - least) * (F.col("x_n") + F.col("y_n")) + EPS
    return x.join(y, ["sh", "deal"]).where(apart & sized & enough & alike).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def groups(docs: DataFrame, known: DataFrame, scratch: Scratch, size: int = 5, bar: float = 0.8, leads: int = 3) -> DataFrame:
    """docs: a written table of node and text; known: other links (a, b) of nodes, kept by the caller.

    (node, component) of all nodes linked by ``known`` or by a similarity of the bar or more.
    """

    @F.pandas_udf("array<bigint>")
    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([band_keys(shingles(t, size)) for t in some])

    @F.pandas_udf("array<bigint>")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([shingles(t, size).view(np.int64) for t in some])

    rows = scratch.keep(docs.select("node", F.explode(keys(F.col("text"))).alias("key")).distinct())
    shared = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    full = scratch.keep(rows.join(shared, "key").select("key", "node", "lead"))
    scratch.drop(rows)
    asked = full.select("node").distinct()
    held = scratch.keep(docs.join(asked, "node", "left_semi").withColumn("set", sets(F.col("text"))).select("node", "set").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = held.select(F.col("node").alias("a"), F.col("set").alias("sa")), held.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("_both", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("_both") >= bar * (F.size("sa") + F.size("sb") - F.col("_both")) - EPS).select("a", "b")

    pairs, left = known, full.where("node <> lead")
    for _ in range(leads):
        found = scratch.keep(confirmed(left.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()))
        pairs = pairs.union(found)
        unlike = left.join(found, (F.col("lead") == F.col("a")) & (F.col("node") == F.col("b")), "left_anti").select("key", "node")
        new = unlike.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
        left = scratch.keep(unlike.join(new, "key").where("node <> lead"))
        if left.isEmpty():
            break
    joined = scratch.keep(connected_components(scratch.keep(pairs), scratch))
    members = scratch.keep(full.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    mixed = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    rest = scratch.keep(members.join(mixed, "key", "left_semi").select("node", "c").distinct())
    met = confirmed(candidates(held.join(rest, "node"), scratch, bar))
    part = lambda side: rest.select(F.col("node").alias(side), F.col("c").alias(f"c{side}"))
    more = met.join(part("a"), "a").join(part("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    above = scratch.keep(connected_components(more, scratch)).select(F.col("node").alias("c"), F.col("component").alias("top"))
    # a component of one node is not among the joined ones
    every = joined.unionByName(above.join(joined, F.col("c") == F.col("node"), "left_anti").select(F.col("c").alias("node"), F.col("c").alias("component")))
    return every.join(above, F.col("component") == F.col("c"), "left").select("node", F.coalesce("top", "component").alias("component"))
