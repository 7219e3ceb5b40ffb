"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of doc_id. A balanced Feistel network over the smallest even number of bits that holds
all numbers permutes them; a value outside the range is permuted again until it falls inside (cycle walking), which
is again a permutation. Place p of the shuffle is slot p // shards of shard p % shards: counts differ by one at most,
slots have no gaps, and row, shard and slot are computed from each other without a lookup.

Nulls and odd rows: a null text has size 16 and the checksum of no bytes. Null doc_ids come first. Rows that agree in
doc_id, size and checksum get adjacent numbers in either order, which the result does not show. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch, whole
from tallyhouse.llm.numbering import with_row_number


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of SplitMix64 over x plus a round key; wraps at 64 bits."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int, rounds: int = 6) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (2**64 - 1))]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        """Where in the shuffle a row number goes."""
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        """The row number at a place of the shuffle."""
        return self._walk(place, True)


def shard(docs: DataFrame, shards: int, scratch: Scratch, seed: int = 17, by: list[str] | None = None) -> DataFrame:
    """docs with row_no, shard and slot; rows are numbered in the order of ``by``."""
    numbered = with_row_number(docs, by or docs.columns, scratch)
    n = numbered.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).place(row.to_numpy()))

    at = numbered.withColumn("_place", place("row_no"))
    return at.withColumns({"shard": F.pmod("_place", F.lit(shards)).cast("int"), "slot": F.expr(f"_place div {shards}")}).drop("_place")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of documents."""
    text = whole(F.col("text"))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
