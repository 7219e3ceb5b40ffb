"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

A fingerprint has 64 bits. Each bit position gets one of the 7 nonzero vectors of {0,1}^3, and table v masks in the
positions whose vector has an odd product with v. Of at most two differing positions, some v is orthogonal to both
vectors, so that the pair agrees on all bits of that table: every pair within 2 bits collides in some table.

Only distinct fingerprints are compared. Buckets of up to ``bucket`` fingerprints are joined with themselves. Larger
ones are not cut: each fingerprint in one meets the others by the 65 words within one bit of it, since two words are
within two bits exactly if some word is within one bit of both; at most 65 fingerprints share such a word, and one
link to the smallest of them keeps all connected.

Nulls and odd rows: a null or empty text has fingerprint zero and links like any other. Copies share a fingerprint
and so a component; repeated rows are returned as often as they occur. A null doc_id never names a component unless
it is alone. Very long texts are handled one at a time. Extra columns are ignored.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.components import connected_components

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, unsigned. bytes.split() without arguments splits at exactly x20 and x09-x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) > shingle else [b" ".join(words)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 16):
        some = parts[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64, len(some))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(parts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([fingerprint(t, shingle) for t in some], dtype="uint64").astype("int64")

    return docs.withColumn(name, F.pandas_udf(fingerprints, "long")(F.col(text)))


def masks() -> list[int]:
    """One mask a table: bit i is in table v if the vector 1 + i % 7 has an odd product with v."""
    found = [sum(1 << i for i in range(64) if bin((1 + i % 7) & v).count("1") % 2) for v in range(1, 8)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, scratch: Scratch, bucket: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) within 2 bits that connect all that are within 2 bits."""
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks())])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    sizes = rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = scratch.keep(rows.join(sizes, ["v", "key"]))
    few = full.where(F.col("n") <= bucket)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = few.select("v", "key", F.col("fp").alias("a")).join(few.select("v", "key", F.col("fp").alias("b")), ["v", "key"]).where("a < b").where(near).select("a", "b")
    balls = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = full.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(balls).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    low = ball.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("z", "a")
    return pairs.union(ball.join(low, "z").where("a <> fp").select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """prints: a written table of doc_id and fp. The same rows with component_id, the smallest doc_id reachable."""
    fps = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected_components(links(fps.select("fp"), scratch), scratch)
    named = fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    ids = scratch.keep(named)
    low = ids.groupBy("c").agg(F.min("least").alias("component_id"))
    return prints.join(ids.join(low, "c").select("fp", "component_id"), "fp")
