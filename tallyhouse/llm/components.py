"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(got)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, component), component being the smallest node reachable.

    Nodes are of any type with an order. Links to itself or to null, repeated links and both directions are allowed.
    Only nodes with a link to another node are returned. Each round is two joins on aggregated minima, written to the
    shared folder; a hub's rows meet one row of the other side, so that Spark can split its partition.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = scratch.keep(edges.where("a <> b").select(hi, lo).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct("lo", F.col("m").alias("to")), F.struct(F.col("hi").alias("lo"), F.col("m").alias("to")))).alias("e"))
        new = scratch.keep(small.select(F.col("e.lo").alias("hi"), F.col("e.to").alias("lo")).where("hi <> lo").distinct())
        scratch.drop(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    root = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(root)
