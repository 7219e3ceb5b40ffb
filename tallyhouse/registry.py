"""All queries of the sales engine by name, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse import oracle, oracle_dirty, oracle_written
from tallyhouse.functions.columns import composite_key, divide
from tallyhouse.operators import anomaly
from tallyhouse.operators.metrics import rollup, with_costs
from tallyhouse.plans import bridge, daily, dirty, listing, sections, weekly, written
from tallyhouse.schema import DEFAULT_RULES, RULES

DAY = bridge.DAY
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Products that sell on most days, for the queries that compare a product's days.
PRODUCTS = 40


def _facts(spark: SparkSession, d: str, rounded: bool = True, products: int | None = None) -> DataFrame:
    return with_costs(bridge.facts(spark, d, products), bridge.skus(spark, d), bridge.channels(spark), rounded)


def _plain(name: str, plan):
    """A query that needs the sales facts, with costs, and nothing else."""
    QUERIES[name] = lambda spark, d: plan(_facts(spark, d))


def _named(name: str, plan):
    """A query that needs channel names too."""
    QUERIES[name] = lambda spark, d: plan(_facts(spark, d), bridge.channels(spark))


_named("by_platform", lambda f, c: daily.by_platform(f, c, DAY))
_named("by_shop", lambda f, c: daily.by_shop(f, c, DAY))
_plain("by_category", lambda f: daily.by_category(f, DAY))
_plain("share_of_net", lambda f: rollup(f, ["category"], DAY).select("category", "share"))
_plain("overall_dod_wow", lambda f: daily.overall(f, DAY))
_plain("overall_metrics", lambda f: daily.overall(f, DAY, compare=False))
_plain("overall_values", lambda f: daily.overall_values(f, DAY))
_plain("refund_rate_7d", lambda f: daily.rolling_refund(f, DAY))
_plain("rolling_7d_series", daily.rolling_series)
_plain("by_sku_unmapped", lambda f: daily.by_unmapped(f, DAY))
_plain("daily_trend_30d", lambda f: daily.trend(f, DAY))
_plain("trend_promo_flags", lambda f: daily.promo_days(daily.trend(f, DAY)))
_plain("cost_coverage", lambda f: daily.cost_coverage(f, DAY))
_plain("gmv_attribution", lambda f: daily.gmv_attribution(f, DAY))
_named("missing_platforms", lambda f, c: daily.missing_platforms(daily.scoped(f, ["jd", "taobao"]), c, DAY))
_named("shipping_note", lambda f, c: daily.shipping_note(f, c, DAY))
_plain("scope_filter", lambda f: daily.overall(daily.scoped(f, ["jd", "taobao"], ["Supplier#000000003", "Supplier#000000004", "Supplier#000000007"]), DAY))
_plain("profit_rows", lambda f: daily.in_window(f, DAY).select("upload_id", "row_no", *[F.col(c).cast("double").alias(c) for c in ("cogs", "platform_fee", "fulfillment_cost", "gross_profit")]))
_plain("meta_platforms", lambda f: listing.values(f, "platform_key"))
_plain("meta_categories", lambda f: listing.values(f, "category"))
_plain("meta_shops", lambda f: listing.values(f, "shop_name", "platform_key", "shop_code"))
_plain("latest_date", lambda f: f.agg(F.max("stat_date").alias("latest_date")))
_plain("upload_unmapped_count", lambda f: f.groupBy("platform_key").agg(F.countDistinct(F.when(F.col("sku_id").isNull(), F.col("platform_product_code"))).alias("unmapped_codes"), F.max("stat_date").alias("last_date")))

_plain("upload_totals", lambda f: daily.upload_totals(daily.upload_results(f)))
_plain("group_keys", lambda f: f.select(composite_key("platform_key", "shop_code").alias("shop"), composite_key("platform_key", "sku_id").alias("sku")).distinct())


@query
def report_sources(spark, d):
    return daily.sources(_facts(spark, d), bridge.uploads(spark, d), DAY)


@query
def profit_summary(spark, d):
    sums = daily.in_window(_facts(spark, d), DAY).groupBy("platform_key").agg(*[F.sum(c).alias(c) for c in ("gross_profit", "covered_net", "ad_cost")])
    operating = (F.col("gross_profit") - F.coalesce("ad_cost", F.lit(0))).cast("double")
    return sums.select("platform_key", F.round(F.col("gross_profit").cast("double"), 2).alias("gross_profit"), F.round(divide(F.col("gross_profit"), F.col("covered_net")), 4).alias("gross_margin"), F.round(operating, 2).alias("operating_profit"))


@query
def by_sku_mapped(spark, d):
    return daily.by_sku(_facts(spark, d), bridge.skus(spark, d), bridge.channels(spark), DAY)


@query
def report_sections(spark, d):
    """Channels, shops, categories, SKUs and products without SKU by one scan; the groups' sums are cached, a row a group."""
    channels = bridge.channels(spark)
    return sections.listed(sections.sums(_facts(spark, d), channels, DAY).cache(), channels, bridge.skus(spark, d))


def _top(kind: str, products: int | None):
    """A top list with its ranks."""
    def run(spark, d):
        rows = daily.by_sku(_facts(spark, d, products=products), bridge.skus(spark, d), bridge.channels(spark), DAY)
        return daily.ranked(rows, f"by_{kind}")

    return run


for _kind in ("gmv", "growth", "decline", "refund"):
    QUERIES[f"top_{_kind}"] = _top(_kind, None if _kind in ("gmv", "refund") else PRODUCTS)


def rules(spark: SparkSession, thresholds: dict[str, str] | None = None) -> DataFrame:
    """The default rules, some with thresholds of their own by name."""
    rows = ", ".join(f"({i}L, '{n}', '{m}', '{s}', '{o}', cast({(thresholds or {}).get(n, t)} as decimal(14,4)), cast({b} as decimal(14,2)), true)" for i, (n, m, s, o, t, b) in enumerate(DEFAULT_RULES, 1))
    return spark.sql(f"select * from values {rows} as t({', '.join(c.split()[0] for c in RULES.split(', '))})")


def _alerts(spark, context: DataFrame, thresholds: dict[str, str] | None = None) -> DataFrame:
    found = anomaly.alerts(context, rules(spark, thresholds))
    return found.select("rule_id", "rule_name", "severity", "scope", "subject", "metric", F.round("value", 6).alias("value"), "threshold", F.round("overshoot", 6).alias("overshoot"))


@query
def anomalies_overall(spark, d):
    return _alerts(spark, anomaly.subjects(_facts(spark, d), "overall", [], F.lit("整体"), DAY), {"整体退款率超限": "0.001"})


@query
def anomalies_platform(spark, d):
    context = anomaly.subjects(_facts(spark, d), "platform", ["platform_key"], F.col("platform_key"), DAY)
    names = bridge.channels(spark).select(F.col("platform_key").alias("subject"), "display_name")
    return _alerts(spark, context.join(names, "subject", "left").withColumn("subject", daily.shown(F.col("subject"), F.col("display_name"))))


@query
def anomalies_sku(spark, d):
    context = anomaly.subjects(_facts(spark, d, products=PRODUCTS).where("sku_id is not null"), "sku", ["sku_id"], F.col("sku_id"), DAY)
    names = bridge.skus(spark, d).select(F.col("id").alias("subject"), F.concat_ws(" ", "sku_code", "name").alias("_n"))
    return _alerts(spark, context.join(names, "subject", "left").withColumn("subject", F.coalesce("_n", F.concat(F.lit("SKU#"), F.col("subject").cast("string")))))


@query
def weekly_totals(spark, d):
    return weekly.totals(_facts(spark, d, rounded=False), DAY)


@query
def weekly_daily(spark, d):
    return weekly.by_day(_facts(spark, d, rounded=False), DAY)


@query
def weekly_platforms(spark, d):
    return weekly.by_platform(_facts(spark, d, rounded=False), bridge.channels(spark), DAY)


@query
def weekly_top_skus(spark, d):
    return weekly.hot_list(_facts(spark, d, rounded=False), bridge.skus(spark, d), bridge.channels(spark), DAY)


QUERIES.update(dirty.QUERIES)
QUERIES.update(written.QUERIES)
ORACLE_SQL: dict[str, str] = {**oracle.SQL, **oracle_dirty.SQL, **oracle_written.SQL}
