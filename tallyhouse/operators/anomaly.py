"""Anomaly rules against the metrics of overall, channels, SKUs, shops and categories.

The subjects are a long table (scope, subject, metric, value, gmv) joined with the enabled rules on scope and metric;
the rules table is a handful of rows, which Spark broadcasts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import divide
from tallyhouse.operators.metrics import derived, of_three_days, period_sums

#: The metrics that rules may name, and their labels.
LABELS = {"gmv_dod": "GMV 环比", "refund_rate": "退款率", "conversion_rate": "转化率", "conversion_rate_dod_pp": "转化率环比", "roi": "推广 ROI", "ad_cost_ratio": "推广费比"}
DIRECTIONS = {"gt": "高于阈值", "lt": "低于阈值", "abs_gt": "波动超过阈值"}


def subjects(facts: DataFrame, scope: str, keys: list[str], subject: Column, day: dt.date, compare: bool = True) -> DataFrame:
    """facts -> scope, subject, metric, value, gmv of the day's groups."""
    sums = of_three_days(facts, day).groupBy(*keys).agg(*period_sums(day, ["gmv", "refund_amount", "net_amount", "buyers", "visitors", "ad_cost"])).where("rows > 0")
    return subjects_of(sums, scope, subject, compare)


def subjects_of(sums: DataFrame, scope: str, subject: Column, compare: bool = True) -> DataFrame:
    """The same from groups' period sums."""
    before = F.col("`gmv@dod`").cast("double")
    values = {m: derived(m) for m in ("refund_rate", "conversion_rate", "roi", "ad_cost_ratio")}
    if compare:
        values["gmv_dod"] = divide(F.col("gmv").cast("double") - before, before)
        values["conversion_rate_dod_pp"] = (derived("conversion_rate") - derived("conversion_rate", "dod")) * 100
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
    gmv = F.coalesce(F.col("gmv").cast("double"), F.lit(0.0)).alias("gmv")
    return sums.select(F.lit(scope).alias("scope"), subject.alias("subject"), gmv, F.explode(pairs).alias("p")).select("scope", "subject", "p.metric", "p.value", "gmv").where("value is not null")


def overshoot(value: Column, operator: Column, threshold: Column) -> Column:
    base = F.abs(threshold)
    over = F.when(operator == "abs_gt", F.abs(value) - base).when(operator == "lt", threshold - value).otherwise(value - threshold)
    return F.when(base == 0, 0.0).otherwise(over / base)


def _shown(metric: Column, v: Column, threshold: bool) -> Column:
    share = F.format_string("%.1f%%", v * 100)
    signed = F.format_string("%+.0f%%" if threshold else "%+.1f%%", v * 100)
    return F.when(metric.isin("refund_rate", "conversion_rate", "ad_cost_ratio"), share).when(metric == "gmv_dod", signed).when(metric == "conversion_rate_dod_pp", F.format_string("%+.1fpp", v)).otherwise(F.format_string("%,.2f", v))


def alerts(context: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that fire: rule_id, rule_name, severity, scope, subject, metric, value, threshold, overshoot, message.

    The order of a list is critical first, then overshoot, then rule and subject.
    """
    enabled = rules.where("enabled").where(F.col("metric").isin(*LABELS)).select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "metric", "scope", "operator", F.col("threshold").cast("double").alias("threshold"), F.col("min_base").cast("double").alias("min_base"))
    met = context.join(enabled, ["scope", "metric"]).where("gmv >= min_base")
    v, t, op = F.col("value"), F.col("threshold"), F.col("operator")
    fired = met.where(F.when(op == "gt", v > t).when(op == "lt", v < t).when(op == "abs_gt", F.abs(v) > t).otherwise(False))
    label = F.coalesce(*[F.when(F.col("metric") == m, x) for m, x in LABELS.items()])
    direction = F.coalesce(*[F.when(op == o, x) for o, x in DIRECTIONS.items()])
    message = F.concat(F.col("subject"), F.lit(" "), label, F.lit(" "), _shown(F.col("metric"), v, False), F.lit("，"), direction, F.lit(" "), _shown(F.col("metric"), t, True))
    scored = fired.withColumn("overshoot", overshoot(v, op, t))
    return scored.select("rule_id", "rule_name", F.when(F.col("overshoot") > 1, "critical").otherwise("warning").alias("severity"), "scope", "subject", "metric", "value", "threshold", "overshoot", message.alias("message"))


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("severity") != "critical", F.desc("overshoot"), "rule_id", "subject")
