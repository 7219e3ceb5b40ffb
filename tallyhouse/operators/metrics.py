"""The daily metric algebra: costs by row, sums by period in one pass, ratios and changes.

All sums keep NULL for all-NULL input; divisions by NULL or 0 are NULL; unknown costs make profit NULL, not 0. A report
compares a day with the day before and the same weekday before, by calendar: sums of all three periods are conditional
sums of one scan and one shuffle, so that no self-join is needed and NULL keys match themselves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import divide, pct_change, pp_change

SUMMED = ["gmv", "refund_amount", "net_amount", "paid_qty", "buyers", "visitors", "ad_cost", "order_qty", "cogs", "gross_profit", "covered_net"]
AMOUNTS = ["gmv", "net_amount", "refund_amount", "paid_qty", "buyers", "visitors", "ad_cost", "avg_order_value", "unit_price", "gross_profit", "operating_profit", "roi", "ad_cost_ratio"]
RATIOS = ["refund_rate", "conversion_rate", "gross_margin"]
PERIODS = {"": 0, "dod": 1, "wow": 7}


def with_costs(facts: DataFrame, skus: DataFrame, channels: DataFrame, rounded: bool = True) -> DataFrame:
    """Adds cogs, platform_fee, fulfillment_cost, gross_profit and covered_net by row.

    Sku and channel tables are joined without hints: Spark broadcasts them while they are small. Daily figures round
    each row to cents, half up; weekly ones don't.
    """
    cost = skus.select(F.col("id").alias("_sku"), "cost_price")
    rates = channels.select(F.col("platform_key").alias("_channel"), "platform_fee_rate", "fulfillment_cost_per_unit")
    joined = facts.join(cost, F.col("sku_id") == F.col("_sku"), "left").join(rates, F.col("platform_key") == F.col("_channel"), "left")
    cents = (lambda c: F.round(c, 2).cast("decimal(24,2)")) if rounded else (lambda c: c.cast("decimal(28,8)"))
    qty = F.col("paid_qty").cast("decimal(12,0)")
    zero = F.lit(0).cast("decimal(4,0)")
    out = joined.withColumns({
        "cogs": cents(F.col("cost_price") * qty),
        "platform_fee": cents(F.col("net_amount") * F.coalesce("platform_fee_rate", zero)),
        "fulfillment_cost": cents(qty * F.coalesce("fulfillment_cost_per_unit", zero)),
    })
    gross = F.col("net_amount") - F.col("cogs") - F.coalesce("platform_fee", zero) - F.coalesce("fulfillment_cost", zero)
    out = out.withColumns({"gross_profit": cents(gross), "covered_net": F.when(F.col("cogs").isNotNull(), F.col("net_amount"))})
    return out.drop("_sku", "_channel", "cost_price", "platform_fee_rate", "fulfillment_cost_per_unit")


def without_costs(facts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("decimal(24,2)")
    return facts.withColumns({c: none for c in ("cogs", "platform_fee", "fulfillment_cost", "gross_profit", "covered_net")})


def name(metric: str, period: str) -> str:
    return f"{metric}@{period}" if period else metric


def period_sums(day: dt.date, fields: list[str] | None = None) -> list[Column]:
    """Conditional sums of the day, the day before and a week before, with the rows each has."""
    out = []
    for p, back in PERIODS.items():
        at = F.col("stat_date") == F.lit(day - dt.timedelta(days=back))
        out += [F.sum(F.when(at, F.col(f))).alias(name(f, p)) for f in fields or SUMMED]
        out.append(F.count(F.when(at, 1)).alias(name("rows", p)))
    return out


def of_three_days(facts: DataFrame, day: dt.date) -> DataFrame:
    """The rows that period_sums() looks at; the list of days reaches the scan."""
    return facts.where(F.col("stat_date").isin(*[day - dt.timedelta(days=b) for b in PERIODS.values()]))


def derived(metric: str, p: str = "") -> Column:
    """A metric of one period from its sums, not rounded."""
    c = lambda f: F.col(f"`{name(f, p)}`")
    parts = {
        "refund_rate": ("refund_amount", "gmv"), "conversion_rate": ("buyers", "visitors"), "avg_order_value": ("net_amount", "buyers"), "unit_price": ("net_amount", "paid_qty"),
        "roi": ("net_amount", "ad_cost"), "ad_cost_ratio": ("ad_cost", "net_amount"), "gross_margin": ("gross_profit", "covered_net"),
    }
    if metric in parts:
        return divide(*map(c, parts[metric]))
    if metric == "operating_profit":
        return (c("gross_profit") - F.coalesce(c("ad_cost"), F.lit(0).cast("decimal(4,0)"))).cast("double")
    return c(metric).cast("double")


def blocks(compare: bool = True, wow: bool = True) -> list[Column]:
    """Value, day-over-day and week-over-week of every metric. Ratios change in points, the others in shares."""
    out = []
    for metrics, digits, change, tail in ((AMOUNTS, 2, pct_change, ""), (RATIOS, 4, pp_change, "_pp")):
        for m in metrics:
            out.append(F.round(derived(m), digits).alias(m))
            for p in ("dod", "wow"):
                on = compare and (wow or p == "dod")
                out.append((change(derived(m), derived(m, p)) if on else F.lit(None).cast("double")).alias(f"{m}_{p}{tail}"))
    return out


def rollup(facts: DataFrame, keys: list[str], day: dt.date, total_net: bool = True, compare: bool = True) -> DataFrame:
    """Rows of a dimension on a day with blocks and, by default, the share of net amount. facts: with costs."""
    sums = of_three_days(facts, day).groupBy(*keys).agg(*period_sums(day)).where("rows > 0")
    return presented(sums, keys, sums.agg(F.sum("net_amount").alias("_whole")) if total_net else None, compare)


def presented(sums: DataFrame, keys: list[str], whole: DataFrame | None, compare: bool = True) -> DataFrame:
    """Groups with blocks, and with their share of the net amount that ``whole``, one row, holds."""
    if whole is None:
        return sums.select(*keys, *blocks(compare))
    shared = sums.crossJoin(F.broadcast(whole)).withColumn("share", F.round(divide(F.col("net_amount"), F.col("_whole")), 4))
    return shared.select(*keys, *blocks(compare), "share")
