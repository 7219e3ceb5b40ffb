"""Approximate nearest neighbours for maximum inner product: score-aware anisotropic quantisation (Guo et al., 2020).

A vector is cut into pairs of coordinates, each quantised to one of 16 centres: four bits. The loss weighs the part of
the residual that is parallel to the vector ``eta`` times the rest, since that part changes large inner products most.
Codes are chosen by coordinate descent, centres by the least squares that the codes give, on a bounded sample
(``sample`` vectors by hash, a documented parameter); every row is then coded and searched.

Rows are dealt into blocks of about ``code_block`` codes with the original vectors beside them, queries into blocks of
about ``query_block``, whatever the table's size, and every query block meets every code block by an equal key: the
stated query set against all rows, in blocks. A task scans the four-bit codes by tables of partial products, two codes a
byte, takes the best ``wide`` rows a query, and scores those exactly in double precision on the original components.
Rows of one approximate score are taken by vec_id, so that equal vectors come in their order. The best k of a query are
kept in each task and then over all tasks.

Nulls and odd rows: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without a vec_id. Rows that share a vec_id are rows of their own: each asks if the
id does, and is a candidate of the others. Empty tables give an empty result. Extra columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import Scratch

CENTRES = 16


class Quantiser:
    """Centres of shape (parts, 16, 2) for vectors padded to an even length."""

    def __init__(self, centres: np.ndarray, eta: float) -> None:
        self.centres, self.eta = centres, eta

    @staticmethod
    def even(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))

    @classmethod
    def fit(cls, x: np.ndarray, eta: float, rounds: int = 6) -> Quantiser:
        x = cls.even(x.astype(np.float64))
        parts = x.shape[1] // 2
        rng = np.random.default_rng(7)
        pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self = cls(x[pick].reshape(CENTRES, parts, 2).transpose(1, 0, 2).copy(), eta)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for turn in range(rounds):
            codes = self.encode(x, sweeps=0 if turn < 2 else 2)
            at = codes + np.arange(parts) * CENTRES  # column pairs of the one-hot design
            columns = (at[:, :, None] * 2 + np.arange(2)).reshape(len(x), -1)
            design = np.zeros((len(x), parts * CENTRES * 2))
            np.put_along_axis(design, columns, unit, axis=1)
            counts, sums = np.zeros(design.shape[1]), np.zeros(design.shape[1])
            np.add.at(counts, columns.ravel(), 1.0)
            np.add.at(sums, columns.ravel(), x.ravel())
            lhs = (eta - 1) * design.T @ design + np.diag(counts + 1e-6)
            solved = np.linalg.solve(lhs, eta * sums + 1e-6 * self.centres.ravel())
            self.centres = solved.reshape(parts, CENTRES, 2)
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, parts): nearest centres, then coordinate descent on the score-aware loss."""
        x = self.even(x.astype(np.float64))
        parts = x.shape[1] // 2
        pieces = x.reshape(len(x), parts, 2)
        gaps = pieces[:, :, None, :] - self.centres[None]  # rows, parts, 16, 2
        square = (gaps**2).sum(-1)
        codes = square.argmin(-1)
        if sweeps:
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), parts, 2)
            along = (gaps * unit[:, :, None, :]).sum(-1)
            rows = np.arange(len(x))
            total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
            for _ in range(sweeps):
                for m in range(parts):
                    rest = total - along[rows, m, codes[:, m]]
                    codes[:, m] = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                    total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte, (bytes, rows)."""
        codes = self.encode(x)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial inner products by byte, (queries, bytes, 256)."""
        q = self.even(queries.astype(np.float64)).reshape(len(queries), -1, 2)
        part = np.einsum("qmd,mcd->qmc", q, self.centres)
        part = np.pad(part / np.maximum(np.abs(part).max((1, 2), keepdims=True), 1e-300), ((0, 0), (0, part.shape[1] % 2), (0, 0)))
        low, high = part[:, ::2], part[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, CENTRES * CENTRES).astype(np.float32)


def highest(near: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest values; of equal ones at the cut the first."""
    if len(near) <= n:
        return np.arange(len(near))
    cut = np.partition(near, len(near) - n)[len(near) - n]
    over = np.flatnonzero(near > cut)
    return np.concatenate([over, np.flatnonzero(near == cut)[: n - len(over)]])


def search(vectors: DataFrame, scratch: Scratch, is_query, k: int = 20, threshold: float = 0.2, sample: int = 4096, wide: int = 100, code_block: int = 4096, query_block: int = 512) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    vectors = vectors.select("vec_id", F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>").alias("embedding"))
    real = np.float32 if kind == "float" else np.float64
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    common = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common["dim"], common["count"]
    valid = valid.where(F.size("embedding") == dim)
    # about ``sample`` rows by content and place, so that neither repeated ids nor repeated vectors crowd it
    dice = F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(1 << 60))
    seen = valid.where(dice < int(min(1.0, sample / n) * (1 << 60))).select("embedding").collect() or valid.select("embedding").take(1)
    square = threshold * threshold
    eta = max(1.0, (dim - 1) * square / (1 - square))
    quantiser = spark.sparkContext.broadcast(Quantiser.fit(np.array([r.embedding for r in seen], np.float64), eta))  # 16 centres of two numbers for each pair of coordinates

    def to_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.concatenate(pdf["embedding"].to_list()).reshape(-1, dim).astype(real)
                codes = np.ascontiguousarray(quantiser.value.packed(x).T)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": [c.tobytes() for c in codes], "raw": [v.tobytes() for v in x]})

    coded = scratch.keep(valid.mapInPandas(to_codes, "vec_id long, code binary, raw binary").withColumn("place", F.monotonically_increasing_id()))
    n_codes, n_queries = -(-n // code_block), -(-n // (query_block * 20))

    def gathered(df: DataFrame, key: str, count: int, *columns: str) -> DataFrame:
        """A row a block: its rows by vec_id."""
        items = df.withColumn(key, F.pmod(F.xxhash64("place", F.lit(key)), F.lit(count)))
        return items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("vec_id", "place", *columns))).alias(f"{key}_items"))

    codes = gathered(coded, "c", n_codes, "code", "raw")
    queries = gathered(coded.where(is_query(F.col("vec_id"))), "q", n_queries, "raw")
    met = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_codes - 1)))).join(codes, "c")
    longs = lambda rows, name: np.array([r[name] for r in rows], np.int64)
    vector = lambda rows: np.frombuffer(b"".join(r["raw"] for r in rows), real).reshape(-1, dim).astype(np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asked, stored in zip(pdf["q_items"], pdf["c_items"], strict=True):
                ids, places, x = longs(stored, "vec_id"), longs(stored, "place"), vector(stored)
                byte_rows = np.ascontiguousarray(np.frombuffer(b"".join(r["code"] for r in stored), np.uint8).reshape(len(ids), -1).T)
                q_ids, q_places, q = longs(asked, "vec_id"), longs(asked, "place"), vector(asked)
                out: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(q), 64):
                    for i, table in enumerate(quantiser.value.tables(q[at : at + 64]), at):
                        near = np.zeros(len(ids), np.float32)
                        for part, row in zip(table, byte_rows, strict=True):
                            near += part[row]
                        best = highest(near, wide + 1)
                        best = best[places[best] != q_places[i]]
                        exact = (x[best] * q[i]).sum(1)
                        order = np.lexsort((ids[best], -exact))[:k]
                        out.append((np.full(len(order), q_places[i]), np.full(len(order), q_ids[i]), ids[best][order], exact[order]))
                if out:
                    yield pd.DataFrame(dict(zip(("place", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = met.select("q_items", "c_items").mapInPandas(scan, "place long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
