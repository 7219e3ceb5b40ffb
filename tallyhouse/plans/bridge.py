"""A view of sales facts over the order tables that the queries run on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schema import CHANNELS

DAY = dt.date(1996, 7, 7)
#: Channels by l_suppkey % 4, their names, fee rates, costs a piece, and whether GMV includes shipping.
CHANNEL_ROWS = [("taobao", "淘宝/天猫（生意参谋）", "0.05", "1.5", False), ("doudian", "抖音电商（抖店罗盘）", "0.03", "2", False), ("pinduoduo", "拼多多（商家后台）", "0", "0", False), ("jd", "京东（京东商智）", "0", "0", True)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, products: int | None = None) -> DataFrame:
    """lineitem with its supplier and part as sales facts. Dates filter the scan; unused columns are never read.

    products: deal the sales to the first so many products, so that each sells on most days.
    """
    li, supplier, part = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    if products:
        li = li.withColumn("l_partkey", F.col("l_partkey") % products + 1)
    rows = li.join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    gmv = F.col("l_extendedprice").cast("decimal(14,2)")
    share = lambda c: F.round(gmv * F.col(c).cast("decimal(4,2)"), 2).cast("decimal(14,2)")
    refund = F.when(F.col("l_returnflag") == "R", share("l_discount")).otherwise(F.lit(0).cast("decimal(14,2)"))
    qty = F.col("l_quantity").cast("long")
    rem = F.col("l_suppkey") % 4
    return rows.select(
        F.col("l_orderkey").alias("upload_id"),
        F.col("l_linenumber").cast("long").alias("row_no"),
        F.col("l_shipdate").cast("date").alias("stat_date"),
        F.when(rem == 0, "taobao").when(rem == 1, "doudian").when(rem == 2, "pinduoduo").otherwise("jd").alias("platform_key"),
        F.col("s_name").alias("shop_code"),
        F.col("s_name").alias("shop_name"),
        F.col("p_partkey").cast("string").alias("platform_product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("sku_id"),
        F.lit(None).cast("long").alias("order_qty"),
        qty.alias("paid_qty"),
        gmv.alias("gmv"),
        refund.alias("refund_amount"),
        (gmv - refund).cast("decimal(14,2)").alias("net_amount"),
        (qty * 8 + F.col("l_orderkey") % 40).alias("visitors"),
        F.greatest(F.lit(1).cast("long"), F.expr("cast(l_quantity as bigint) * 4 div 5")).alias("buyers"),
        share("l_tax").alias("ad_cost"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("订单"), F.col("o_orderkey"), F.lit(".csv")).alias("filename"))


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.round(F.col("p_retailprice").cast("decimal(14,2)") * F.lit("0.6").cast("decimal(3,1)"), 2).cast("decimal(14,2)")
    return read(spark, sf_dir, "part").where(F.col("p_partkey") % 5 != 0).select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("K"), F.col("p_partkey")).alias("sku_code"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 7 != 0, cost).alias("cost_price"), F.lit("active").alias("status"),
    )


def channels(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{k}', '{n}', cast({f} as decimal(10,6)), cast({c} as decimal(14,4)), {str(s).lower()})" for k, n, f, c, s in CHANNEL_ROWS)
    return spark.sql(f"select * from values {values} as t({', '.join(f.split()[0] for f in CHANNELS.split(', '))})")
