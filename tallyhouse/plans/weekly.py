"""The weekly report. Its rules differ from the daily ones on purpose: sums are 0 where there is nothing, divisors must
be over 0, and costs aren't rounded by row. facts: with costs that aren't rounded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import weekday_name
from tallyhouse.plans.daily import shown

SUMS = ["gmv", "net_amount", "refund_amount", "paid_qty", "buyers", "ad_cost"]


def bounds(day: dt.date) -> tuple[dt.date, dt.date]:
    monday = day - dt.timedelta(days=day.weekday())
    return monday, monday + dt.timedelta(days=6)


def _two_weeks(facts: DataFrame, day: dt.date) -> DataFrame:
    monday, sunday = bounds(day)
    near = facts.where(F.col("stat_date").between(F.lit(monday - dt.timedelta(days=7)), F.lit(sunday)))
    return near.withColumn("this", F.col("stat_date") >= F.lit(monday))


def _sums(this: bool | None, p: str) -> list[Column]:
    on = lambda c: F.when(F.col("this") == this, c) if this is not None else c
    zero = [F.coalesce(F.sum(on(F.col(c))), F.lit(0)).cast("double").alias(p + c) for c in SUMS]
    known = F.when(F.col("gross_profit").isNotNull(), F.col("net_amount"))
    return [*zero, F.sum(on(F.col("gross_profit"))).cast("double").alias(p + "gross_profit"), F.sum(on(known)).cast("double").alias(p + "covered_net"), F.count(on(F.lit(1))).alias(p + "rows")]


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _derived(p: str) -> dict[str, Column]:
    c = lambda n: F.col(p + n)
    return {
        "refund_rate": _over(c("refund_amount"), c("gmv")),
        "gross_margin": _over(c("gross_profit"), c("covered_net")),
        "avg_order_value": F.when(c("buyers") > 0, _over(c("net_amount"), c("buyers"))).otherwise(_over(c("net_amount"), c("paid_qty"))),
        "roi": _over(c("net_amount"), c("ad_cost")),
    }


def _wow(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before)


def totals(facts: DataFrame, day: dt.date) -> DataFrame:
    """One row: totals of the week, of the week before (NULL where it has no rows), and changes."""
    got = _two_weeks(facts, day).agg(*_sums(True, "c_"), *_sums(False, "p_"))
    was = F.col("p_rows") > 0
    cur, prev = _derived("c_"), _derived("p_")
    out: list[Column] = []
    for m in ("gmv", "net_amount", "refund_amount", "gross_profit"):
        out += [F.round("c_" + m, 2).alias("total_" + m), F.when(was, F.round("p_" + m, 2)).alias("prev_" + m), F.round(_wow(F.col("c_" + m), F.col("p_" + m)), 6).alias("wow_" + m)]
    out += [F.col("c_paid_qty").cast("long").alias("total_paid_qty"), F.when(was, F.col("p_paid_qty").cast("long")).alias("prev_paid_qty"), F.round(_wow(F.col("c_paid_qty"), F.col("p_paid_qty")), 6).alias("wow_paid_qty")]
    for m in ("refund_rate", "gross_margin"):
        out += [F.round(cur[m], 4).alias("total_" + m), F.when(was, F.round(prev[m], 4)).alias("prev_" + m), F.when(was, F.round((cur[m] - prev[m]) * 100, 2)).alias(f"wow_{m}_pp")]
    for m in ("avg_order_value", "roi"):
        out += [F.round(cur[m], 2).alias("total_" + m), F.when(was, F.round(prev[m], 2)).alias("prev_" + m), F.round(_wow(cur[m], prev[m]), 6).alias("wow_" + m)]
    return got.select(*out)


def by_day(facts: DataFrame, day: dt.date) -> DataFrame:
    """Seven rows, Monday to Sunday."""
    monday, sunday = bounds(day)
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(monday), F.lit(sunday))).alias("stat_date"))
    got = _two_weeks(facts, day).where("this").groupBy("stat_date").agg(*_sums(None, "c_"))
    d = _derived("c_")
    zero = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0)).alias(c[2:])
    return spine.join(got, "stat_date", "left").select("stat_date", weekday_name(F.col("stat_date")).alias("weekday"), zero("c_gmv"), zero("c_net_amount"), F.round(d["refund_rate"], 4).alias("refund_rate"), F.round("c_gross_profit", 2).alias("gross_profit"), F.round(d["gross_margin"], 4).alias("gross_margin"), F.coalesce(F.col("c_paid_qty").cast("long"), F.lit(0)).alias("paid_qty"), F.round(d["avg_order_value"], 2).alias("avg_order_value"), F.round(d["roi"], 2).alias("roi"))


def _week_gmv(facts: DataFrame, day: dt.date) -> DataFrame:
    return _two_weeks(facts, day).where("this").agg(F.coalesce(F.sum("gmv"), F.lit(0)).cast("double").alias("week_gmv"))


def by_platform(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    near = _two_weeks(facts, day).where("platform_key is not null and platform_key <> ''")
    got = near.groupBy("platform_key").agg(*_sums(True, "c_"), F.coalesce(F.sum(F.when(~F.col("this"), F.col("gmv"))), F.lit(0)).cast("double").alias("p_gmv")).where("c_rows > 0")
    names = channels.select(F.col("platform_key").alias("_k"), "display_name")
    rows = got.join(_week_gmv(facts, day), how="cross").join(names, F.col("platform_key") == F.col("_k"), "left")
    return rows.select("platform_key", shown(F.col("platform_key"), F.col("display_name")).alias("platform_name"), F.round("c_gmv", 2).alias("gmv"), F.round(_over(F.col("c_gmv"), F.col("week_gmv")), 4).alias("share"), F.round("c_net_amount", 2).alias("net_amount"), F.round(_derived("c_")["refund_rate"], 4).alias("refund_rate"), F.round("c_gross_profit", 2).alias("gross_profit"), F.round(_wow(F.col("c_gmv"), F.col("p_gmv")), 6).alias("wow_gmv"))


def hot_list(facts: DataFrame, skus: DataFrame, channels: DataFrame, day: dt.date, n: int = 10) -> DataFrame:
    """The week's products by GMV; a product goes by SKU code, else code, else name. Name and channel are its first row's."""
    codes = skus.select(F.col("id").alias("_id"), "sku_code")
    names = channels.select(F.col("platform_key").alias("_k"), "display_name")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = _two_weeks(facts, day).where("this").join(codes, F.col("sku_id") == F.col("_id"), "left")
    key = F.coalesce(text("sku_code"), text("platform_product_code"), text("product_name"), F.lit("未知"))
    first = F.min_by(F.struct(F.coalesce(text("product_name"), text("sku_code"), F.col("key")).alias("name"), F.col("platform_key").alias("platform_key")), F.struct("upload_id", "row_no")).alias("f")
    got = rows.withColumn("key", key).groupBy("key").agg(first, *[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias("_" + c) for c in ("gmv", "refund_amount", "paid_qty")])
    ranked = got.orderBy(F.desc("_gmv"), "key").limit(n).join(_week_gmv(facts, day), how="cross").join(names, F.col("f.platform_key") == F.col("_k"), "left")
    platform = F.when(F.coalesce(F.col("f.platform_key"), F.lit("")) == "", "全网").otherwise(shown(F.col("f.platform_key"), F.col("display_name")))
    return ranked.select("key", F.col("f.name").alias("name"), platform.alias("platform"), F.round("_gmv", 2).alias("gmv"), F.round("_refund_amount", 2).alias("refund_amount"), F.col("_paid_qty").cast("long").alias("paid_qty"), F.round(_over(F.col("_refund_amount"), F.col("_gmv")), 4).alias("refund_rate"), F.round(_over(F.col("_gmv"), F.col("week_gmv")), 4).alias("share"))
