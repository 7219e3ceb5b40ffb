"""Toxicity: FTRL-proximal logistic regression (McMahan et al., 2013) over hashed word n-grams and skip-grams.

A text's features are its distinct words, neighbouring pairs and pairs with one word between, hashed to 2^18 indexes.
Training rows, about ``most_rows`` of them by hash of doc_id (a documented bound), are dealt over a fixed number
of shards. In each round every shard goes over its rows once, from the state all shards start with, by per-coordinate
rates and L1 shrinkage; the states are averaged by a grouped sum. The weights that L1 leaves are few: at most one
for each index, 2 MB in all, so that they are broadcast to the scoring tasks.

Nulls and odd rows: a null or empty text has no features and gets the prior's score. Labels other than 0 and 1 or null
do not train; a row with several labels trains once with each. Without any training rows every score is 0.5. Very long
texts are scored piece by piece. Extra columns are ignored.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch

BITS = 18
BIAS = 1 << BITS
WORD = re.compile(r"[^\W\d_]+")
STATE = "idx int, z double, n double"


class Hasher:
    """Words to 64-bit numbers, remembered within a task up to a bound."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        try:
            return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(self.known) > self.most:
                self.known = {}
            new = list(set(found).difference(self.known))
            self.known.update(zip(new, pd.util.hash_array(np.array(new, dtype=object), categorize=False).tolist(), strict=True))
            return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))


def _index(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(h: np.ndarray) -> np.ndarray:
    """Indexes, with repeats, of words, pairs and pairs with one word between."""
    pair = lambda a, b, c: _index(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(c))
    return np.concatenate([_index(h), pair(h[:-1], h[1:], 1), pair(h[:-2], h[2:], 2)])


def weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _train_shard(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]], hyper: dict) -> None:
    for idx, y in rows:
        w = weights(z[idx], n[idx], **hyper)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / hyper["alpha"]
        z[idx] += g - sigma * w
        n[idx] += g * g


def train(labelled: DataFrame, scratch: Scratch, most_rows: int = 20_000, shards: int = 8, rounds: int = 10, least_docs: int = 5, alpha: float = 3.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> DataFrame:
    """labelled: doc_id, text, label -> the sparse model (idx, w) as a written table.

    Indexes in fewer than ``least_docs`` training rows are left out. A coordinate moves by the mean of the shards
    that touched it, so that a rare word isn't held back by shards without it.
    """
    spark, hyper = labelled.sparkSession, {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    valid = labelled.where(F.col("label").isin(0, 1))
    keep = min(1.0, most_rows / max(valid.count(), 1))
    rows = valid.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", "label").alias("h"))
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < int(keep * (1 << 20)))

    def indexes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for part in texts:
            yield pd.Series([np.unique(features(hasher.words(t or ""))) for t in part])

    idx = F.pandas_udf(indexes, "array<int>")(F.col("text"))
    dealt = scratch.keep(some.select("h", "label", idx.alias("idx"), F.pmod(F.shiftright("h", 24), F.lit(shards)).cast("int").alias("shard")))
    frequent = dealt.select(F.explode("idx").alias("idx")).groupBy("idx").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("idx")
    used = spark.sparkContext.broadcast(frequent.toPandas()["idx"].to_numpy())  # at most 2^18
    state = scratch.keep(spark.createDataFrame([], STATE))

    def from_state(start):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            z, n, ok = np.zeros(BIAS + 1), np.zeros(BIAS + 1), np.zeros(BIAS + 1, bool)
            z[start.value["idx"]], n[start.value["idx"]] = start.value["z"], start.value["n"]
            ok[used.value] = True
            z0, n0 = z.copy(), n.copy()
            pdf = pdf.sort_values(["h", "label"])
            _train_shard(z, n, [(np.append(i[ok[i]], BIAS), y) for i, y in zip(pdf["idx"], pdf["label"], strict=True)], hyper)
            at = np.flatnonzero(n != n0)
            return pd.DataFrame({"idx": at.astype(np.int32), "z": (z - z0)[at], "n": (n - n0)[at]})

        return one

    for _ in range(rounds):
        start = spark.sparkContext.broadcast(state.toPandas())  # at most 2^18 + 1 rows
        moved = dealt.groupBy("shard").applyInPandas(from_state(start), STATE).groupBy("idx").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
        new = scratch.keep(state.union(moved).groupBy("idx").agg(F.sum("z").alias("z"), F.sum("n").alias("n")))
        scratch.drop(state)
        state = new
    w = -(F.col("z") - F.signum("z") * l1) / ((beta + F.sqrt("n")) / alpha + l2)
    return scratch.keep(state.where(F.abs("z") > l1).select("idx", w.alias("w")))


def score(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """docs with score. The model has one row an index at most, so it may be broadcast whole."""
    found = docs.sparkSession.sparkContext.broadcast(model.toPandas())

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(BIAS + 1)
        w[found.value["idx"]] = found.value["w"]
        used, hasher = w != 0, Hasher()

        def one(text: str | None) -> float:
            idx = features(hasher.words(text or ""))
            at = np.unique(idx[used[idx]])
            return w[at].sum() + w[BIAS]

        for some in texts:
            yield pd.Series(1 / (1 + np.exp(-np.clip([one(t) for t in some], -35, 35))))

    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text)))
