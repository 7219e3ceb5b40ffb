"""Queries through files and table writes: line items as channel files read back, and products mapped anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import identity
from tallyhouse.operators.normalize import ERROR, finished, typed
from tallyhouse.plans import bridge
from tallyhouse.plans.dirty import dealt
from tallyhouse.session import stored
from tallyhouse.sinks import detail
from tallyhouse.sources import files, generator, spec

#: Orders of a file; an order has seven lines at most.
ORDERS = 8000
SUMS = ["gmv", "refund_amount", "ad_cost", "paid_qty", "visitors", "buyers"]


#: What the merge and the sums read of a cast row.
READ = ["upload_id", "row_no", "stat_date", "platform_key", "platform_product_code", "shop_code", "gmv", "refund_amount", "ad_cost", "paid_qty", "order_qty", "visitors", "buyers"]


def _facts(made: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The facts of the channels' files: for each channel its files (path, content, sha256) and their header. Texts that no sum needs are null.

    What each file holds is made, read and cast once, by the task that has the file. The good rows of all channels are
    written as one table by one job, for the steps of the merge.
    """
    rows = None
    for key, (found, header) in made.items():
        own = spec.builtin(key)
        read = files.parsed(found, own.file_matching, only=("path", "row_no", "cells")).where("cells is not null").select(F.xxhash64("path").alias("upload_id"), "row_no", "cells")
        good = typed(read, header, own, ("upload_id",)).where(F.size("_errors") == 0)
        good = good.select(*[c for c in READ if c in good.columns])
        rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
    cast = stored(rows).withColumns({"raw": F.lit(None).cast("string"), "_errors": F.array().cast(ERROR)})
    out = None
    for key in made:
        facts = finished(cast.where(F.col("platform_key") == key), spec.builtin(key)).facts
        out = facts if out is None else out.unionByName(facts)
    return out


def channel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as files of their channels, and these read, cast and merged: sums by channel and day.

    Every channel's encoding, delimiter, title, footer and spelling is written and read. An amount in 97 is no number.
    """
    sold = bridge.facts(spark, sf_dir).withColumns({"kind": F.when(F.pmod(F.col("upload_id") + F.col("row_no"), F.lit(97)) == 0, "bad").otherwise("plain"), "slash": F.col("upload_id") % 10 == 0})
    made = {}
    for key in generator.CHANNELS:
        rows = generator.cells(sold, key).select(F.expr(f"upload_id div {ORDERS}").alias("file"), F.lit("1998-12-31").alias("until"), F.struct("upload_id", "row_no", "shop_code", "platform_product_code", "gmv").alias("at"), "cells")
        found = generator.packed(rows, key).withColumn("sha256", F.sha2("content", 256))
        made[key] = found, list(spec.builtin(key).column_map)
    out = _facts(made)
    sums = [F.sum(c).cast("decimal(20,2)" if c in ("gmv", "refund_amount", "ad_cost") else "long").alias(c) for c in SUMS]
    return out.groupBy("platform_key", "stat_date").agg(F.count("*").alias("n_facts"), *sums)


def detail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as detail files of their channels and days, and these read, cast and merged: the same sums by channel and day."""
    specs = {k: spec.builtin(k) for k in spec.builtin_keys()}
    made = stored(detail.parts(bridge.facts(spark, sf_dir), specs, stored).select("path", "content", F.sha2("content", 256).alias("sha256"), "platform_key"), "platform_key")
    out = _facts({key: (dealt(made.where(F.col("platform_key") == key), "path"), [s for _, s in detail.columns(own)]) for key, own in specs.items()})
    sums = [F.sum(c).cast("decimal(20,2)" if c in ("gmv", "refund_amount", "ad_cost") else "long").alias(c) for c in SUMS]
    return out.groupBy("platform_key", "stat_date").agg(*sums)


def sku_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that mapping products of one channel anew must write: all of the uploads that hold one of them."""
    facts = bridge.facts(spark, sf_dir)
    part = bridge.read(spark, sf_dir, "part").where("p_partkey % 30 = 0")
    changes = part.select(F.lit("taobao").alias("platform_key"), F.col("p_partkey").cast("string").alias("platform_product_code"), (F.col("p_partkey") + 1).alias("_new"))
    return identity.backfilled(facts, changes).select("upload_id", "row_no", "platform_key", "platform_product_code", "sku_id")


def sku_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for products that lose the SKU they are mapped to, where they have it."""
    facts = bridge.facts(spark, sf_dir)
    part = bridge.read(spark, sf_dir, "part").where("p_partkey % 20 = 7 or p_partkey % 20 = 13")
    old = F.col("p_partkey") + F.when(F.col("p_partkey") % 20 == 13, 1).otherwise(0)
    changes = part.select(F.lit("jd").alias("platform_key"), F.col("p_partkey").cast("string").alias("platform_product_code"), F.lit(None).cast("long").alias("_new"), old.alias("_old"))
    return identity.backfilled(facts, changes, only_old=True).select("upload_id", "row_no", "platform_key", "platform_product_code", "sku_id")


QUERIES = {f.__name__: f for f in (channel_files, detail_files, sku_backfill, sku_cleared)}
