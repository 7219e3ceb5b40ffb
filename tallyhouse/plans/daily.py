"""Sections of the daily report, each a DataFrame. facts: the sales facts with costs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.columns import blank_to_null, divide
from tallyhouse.operators import attribution
from tallyhouse.operators.metrics import AMOUNTS, RATIOS, blocks, derived, name, of_three_days, period_sums, rollup

WINDOW_DAYS = 30


def scoped(facts: DataFrame, platforms: list[str] | None = None, shops: list[str] | None = None) -> DataFrame:
    """Rows of the given channels, and of shops by code or name."""
    if platforms:
        facts = facts.where(F.col("platform_key").isin(*platforms))
    if shops:
        facts = facts.where(F.col("shop_code").isin(*shops) | F.col("shop_name").isin(*shops))
    return facts


def sources(facts: DataFrame, uploads: DataFrame, day: dt.date) -> DataFrame:
    """Uploads that rows of the day came from."""
    of_day = facts.where(F.col("stat_date") == F.lit(day)).select(F.col("upload_id").alias("id"))
    return uploads.join(of_day, "id", "left_semi")


def upload_results(facts: DataFrame) -> DataFrame:
    """Rows, products without a SKU and the latest date of each upload."""
    unmapped = F.countDistinct(F.when(F.col("sku_id").isNull(), F.struct("platform_key", "platform_product_code")))
    return facts.groupBy("upload_id").agg(F.count("*").alias("valid"), unmapped.alias("unmapped_codes"), F.max("stat_date").alias("latest_date"))


def upload_totals(results: DataFrame) -> DataFrame:
    """What several uploads came to together."""
    return results.agg(F.sum("valid").alias("valid"), F.sum("unmapped_codes").alias("unmapped_codes"), F.max("latest_date").alias("latest_date"))


def in_window(facts: DataFrame, day: dt.date, days: int = WINDOW_DAYS) -> DataFrame:
    return facts.where(F.col("stat_date").between(F.lit(day - dt.timedelta(days=days - 1)), F.lit(day)))


def shown(key: Column, display: Column) -> Column:
    return F.coalesce(display, key, F.lit("未知平台"))


def _named(rows: DataFrame, channels: DataFrame) -> DataFrame:
    names = channels.select(F.col("platform_key").alias("_k"), "display_name")
    return rows.join(names, F.col("platform_key") == F.col("_k"), "left").withColumn("platform_name", shown(F.col("platform_key"), F.col("display_name"))).drop("_k", "display_name")


def rolling_refund(facts: DataFrame, day: dt.date) -> DataFrame:
    """One row: refund over GMV of the seven days up to the day, the day before and a week before."""
    out = []
    for p, back in (("", 0), ("dod", 1), ("wow", 7)):
        last = day - dt.timedelta(days=back)
        within = F.col("stat_date").between(F.lit(last - dt.timedelta(days=6)), F.lit(last))
        out.append(divide(F.sum(F.when(within, F.col("refund_amount"))), F.sum(F.when(within, F.col("gmv")))).alias(name("rate", p)))
    got = in_window(facts, day, 14).agg(*out)
    pp = lambda p: F.round((F.col("rate") - F.col(f"`{name('rate', p)}`")) * 100, 4)
    return got.select(F.round("rate", 4).alias("refund_rate_7d"), pp("dod").alias("refund_rate_7d_dod_pp"), pp("wow").alias("refund_rate_7d_wow_pp"))


def rolling_series(facts: DataFrame) -> DataFrame:
    """For every day with rows: refund over GMV of its seven calendar days, by channel."""
    by_day = facts.groupBy("platform_key", "stat_date").agg(F.sum("gmv").alias("gmv"), F.sum("refund_amount").alias("refund_amount"))
    week = Window.partitionBy("platform_key").orderBy(F.unix_date("stat_date")).rangeBetween(-6, 0)
    return by_day.select("platform_key", "stat_date", F.round(divide(F.sum("refund_amount").over(week), F.sum("gmv").over(week)), 4).alias("refund_rate_7d"))


def overall(facts: DataFrame, day: dt.date, compare: bool = True) -> DataFrame:
    return of_three_days(facts, day).agg(*period_sums(day)).select(*blocks(compare))


def overall_values(facts: DataFrame, day: dt.date) -> DataFrame:
    """metric, today, dod_value, wow_value: the absolute values of the three days."""
    return values_of(of_three_days(facts, day).agg(*period_sums(day)))


def values_of(sums: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), *[F.round(derived(m, p), digits).alias(a) for p, a in (("", "today"), ("dod", "dod_value"), ("wow", "wow_value"))]) for ms, digits in ((AMOUNTS, 2), (RATIOS, 4)) for m in ms]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def by_platform(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    return platform_rows(rollup(facts, ["platform_key"], day), channels)


def platform_rows(rows: DataFrame, channels: DataFrame) -> DataFrame:
    return _named(rows, channels)


def by_shop(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    return shop_rows(rollup(facts, ["platform_key", "shop_code", "shop_name"], day), channels)


def shop_rows(rows: DataFrame, channels: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.col(c) != "__UNKNOWN__", blank_to_null(F.col(c)))
    return _named(rows, channels).withColumn("display", F.concat("platform_name", F.lit(" · "), F.coalesce(known("shop_name"), known("shop_code"), F.lit("未命名店铺"))))


def by_category(facts: DataFrame, day: dt.date) -> DataFrame:
    return category_rows(rollup(facts, ["category"], day))


def category_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("display", F.coalesce(blank_to_null(F.col("category")), F.lit("未分类")))


def names_of_day(day: dt.date) -> list[Column]:
    """Of a group's rows of the day: the channels' names, sorted, and the first category and product name. Rows need display_name."""
    today = F.col("stat_date") == F.lit(day)
    seen = F.collect_set(F.when(today, shown(F.col("platform_key"), F.col("display_name"))))
    first = lambda c: F.min(F.when(today & F.col(c).isNotNull(), F.struct("upload_id", "row_no", c)))[c]
    return [F.array_join(F.array_sort(seen), "、").alias("platforms"), first("category").alias("_category"), first("product_name").alias("_name")]


def by_sku(facts: DataFrame, skus: DataFrame, channels: DataFrame, day: dt.date, compare: bool = True) -> DataFrame:
    """Mapped SKUs of the day. Channels are listed by name; a SKU without a record goes by its number."""
    mapped = of_three_days(facts, day).where("sku_id is not null")
    names = channels.select(F.col("platform_key").alias("_k"), "display_name")
    sums = mapped.join(names, F.col("platform_key") == F.col("_k"), "left").groupBy("sku_id").agg(*period_sums(day), *names_of_day(day)[:2]).where("rows > 0")
    return sku_rows(sums, skus, compare)


def sku_rows(sums: DataFrame, skus: DataFrame, compare: bool = True) -> DataFrame:
    records = skus.select(F.col("id").alias("_id"), "sku_code", "name", F.col("category").alias("_own"))
    out = sums.join(records, F.col("sku_id") == F.col("_id"), "left")
    return out.select(
        "sku_id", F.coalesce("sku_code", F.col("sku_id").cast("string")).alias("sku_code"), F.coalesce("name", F.concat(F.lit("SKU#"), F.col("sku_id").cast("string"))).alias("name"),
        F.coalesce(blank_to_null(F.col("_own")), F.col("_category")).alias("category"), "platforms", F.round(F.col("`gmv@dod`").cast("double"), 2).alias("gmv_yesterday"), *blocks(compare),
    )


def by_unmapped(facts: DataFrame, day: dt.date, compare: bool = True) -> DataFrame:
    """Codes with rows of the day that have no SKU. Their sums are of those rows; the day before counts all rows."""
    near = of_three_days(facts, day)
    free = near.where(F.col("sku_id").isNull() | (F.col("stat_date") < F.lit(day)))
    today = F.col("stat_date") == F.lit(day)
    first = F.min(F.when(today & F.col("product_name").isNotNull(), F.struct("upload_id", "row_no", "product_name")))["product_name"]
    sums = free.groupBy("platform_key", "platform_product_code").agg(*period_sums(day), first.alias("_name")).where("rows > 0")
    return unmapped_rows(sums, compare)


def unmapped_rows(sums: DataFrame, compare: bool = True) -> DataFrame:
    return sums.select("platform_key", "platform_product_code", F.coalesce("_name", "platform_product_code").alias("product_name"), *blocks(compare, wow=False))


def trend(facts: DataFrame, day: dt.date, days: int = WINDOW_DAYS) -> DataFrame:
    """A row for each of the last days, with NULLs where there were no sales."""
    start = day - dt.timedelta(days=days - 1)
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(day))).alias("stat_date"))
    sums = in_window(facts, day, days).groupBy("stat_date").agg(*[F.sum(c).alias(c) for c in ("gmv", "net_amount", "refund_amount")])
    rate = F.round(divide(F.col("refund_amount"), F.col("gmv")), 4)
    return spine.join(sums, "stat_date", "left").select("stat_date", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("gmv", "net_amount")], rate.alias("refund_rate"))


def promo_days(trend_rows: DataFrame) -> DataFrame:
    """Days whose GMV is at least twice the upper median of the trend; none with fewer than four days of sales."""
    found = trend_rows.agg(F.array_sort(F.collect_list("gmv")).alias("v")).select(F.when(F.size("v") >= 4, F.get("v", F.expr("size(v) div 2"))).alias("median"))
    flag = F.coalesce(F.col("gmv") >= 2 * F.col("median"), F.lit(False))
    return trend_rows.join(found, how="cross").select("stat_date", "gmv", flag.alias("is_promo"))


TOP_COLUMNS = ["sku_id", "sku_code", "name", "category", "gmv", "net_amount", "refund_rate", "gmv_dod"]


def top(sku_rows: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """by_gmv, by_growth, by_decline or by_refund of by_sku() rows, ranked; a fall of zero counts as a decline."""
    base = F.col("gmv_dod").isNotNull() & (F.col("gmv_yesterday") > 1000)
    where, order = {
        "by_gmv": (F.lit(True), F.col("gmv").desc_nulls_last()),
        "by_growth": (base & (F.col("gmv_dod") > 0), F.col("gmv_dod").desc()),
        "by_decline": (base & (F.col("gmv_dod") <= 0), F.col("gmv_dod").asc()),
        "by_refund": ((F.col("gmv") > 500) & F.col("refund_rate").isNotNull(), F.col("refund_rate").desc()),
    }[kind]
    return sku_rows.where(where).select(*TOP_COLUMNS).orderBy(order, F.coalesce("net_amount", F.lit(0.0)).desc(), "sku_id").limit(n)


def ranked(sku_rows: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """top() with rank from 1; the window sees n rows."""
    order = {"by_gmv": F.col("gmv").desc(), "by_growth": F.col("gmv_dod").desc(), "by_decline": F.col("gmv_dod").asc(), "by_refund": F.col("refund_rate").desc()}[kind]
    return top(sku_rows, kind, n).withColumn("rank", F.row_number().over(Window.orderBy(order, F.coalesce("net_amount", F.lit(0.0)).desc(), "sku_id")))


def missing_platforms(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    present = facts.where(F.col("stat_date") == F.lit(day)).select("platform_key").distinct()
    return channels.select("platform_key", "display_name").join(present, "platform_key", "left_anti")


def cost_coverage(facts: DataFrame, day: dt.date) -> DataFrame:
    """One row: the share of the day's net amount whose cost is known; 0 if none is, NULL without any."""
    sums = facts.where(F.col("stat_date") == F.lit(day)).agg(F.sum("net_amount").alias("net"), F.sum("covered_net").alias("covered"))
    share = F.when(F.coalesce(F.col("net"), F.lit(0)) != 0, F.coalesce(F.round(divide(F.col("covered"), F.col("net")), 4), F.lit(0.0)))
    return sums.select(share.alias("cost_coverage"))


def shipping_note(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    """One row: the note on channels of the window whose GMV includes shipping; NULL if there are none."""
    seen = in_window(facts, day).select("platform_key").distinct().join(channels.where("gmv_includes_shipping"), "platform_key")
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("platform_key", "display_name"))), lambda c: F.concat(F.lit("*"), c["display_name"], F.lit("GMV含运费"))), "、")
    return seen.agg(F.nullif(note, F.lit("")).alias("note"))


def gmv_attribution(facts: DataFrame, day: dt.date) -> DataFrame:
    sums = of_three_days(facts, day).agg(*period_sums(day, ["gmv", "visitors", "buyers"]))
    c = [F.col(f"`{name(f, p)}`") for p in ("", "dod") for f in ("gmv", "visitors", "buyers")]
    return sums.select(*[v.alias(k) for k, v in attribution.contributions(*c).items()])
