"""Every section of the daily report that sums over a dimension, from one scan and one shuffle of three days' rows.

Rows are grouped by all dimensions at once, as grouping sets; grouping_id tells a dimension's NULL from the sets that leave
it out. Tasks combine before the shuffle, so that the total and large channels are no hot keys. The result has a row a
group and is what the sections are made of: keep it (cache() or a table) when more than one of them is wanted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.metrics import blocks, of_three_days, period_sums, presented
from tallyhouse.plans import daily

#: Sections by the columns that make their groups. ``free`` is the product of a row that counts for the products without SKU.
SETS = {"overall": [], "platform": ["platform_key"], "shop": ["platform_key", "shop_code", "shop_name"], "category": ["category"], "sku": ["sku_id"], "unmapped": ["free"]}
KEYS = list(dict.fromkeys(k for s in SETS.values() for k in s))


def grouping(section: str) -> int:
    """What grouping_id is for a section: a bit for each key that it leaves out, the first key highest."""
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in SETS[section])


def sums(facts: DataFrame, channels: DataFrame, day: dt.date) -> DataFrame:
    """section, the keys, sums of the three days, and names as of the day. facts: with costs.

    The total has a row if one of the three days has sales; every other group has sales of the day. Groups of rows without SKU, and of
    rows that have one, are left out of the sections of SKUs and of products without SKU.
    """
    near = of_three_days(facts, day)
    names = channels.select(F.col("platform_key").alias("_k"), "display_name")
    free = F.when(F.col("sku_id").isNull() | (F.col("stat_date") < F.lit(day)), F.struct("platform_key", "platform_product_code"))
    rows = near.join(names, F.col("platform_key") == F.col("_k"), "left").drop("_k").withColumn("free", free)
    found = rows.groupingSets([[F.col(k) for k in s] for s in SETS.values()], *KEYS).agg(F.grouping_id().alias("_set"), *period_sums(day), *daily.names_of_day(day))
    section = F.coalesce(*[F.when(F.col("_set") == grouping(s), s) for s in SETS]).alias("section")
    named = found.select(section, *[c for c in found.columns if c != "_set"])
    absent = ((F.col("section") == "sku") & F.col("sku_id").isNull()) | ((F.col("section") == "unmapped") & F.col("free").isNull())
    return named.where(((F.col("rows") > 0) | (F.col("section") == "overall")) & ~absent)


def of(found: DataFrame, section: str) -> DataFrame:
    """The sums of one section by its own keys."""
    return found.where(F.col("section") == section)


def parts(found: DataFrame, channels: DataFrame, skus: DataFrame, compare: bool = True) -> dict[str, DataFrame]:
    """The sections as daily.overall(), by_platform(), by_shop(), by_category(), by_sku() and by_unmapped() give them."""
    whole = of(found, "overall").select(F.col("net_amount").alias("_whole"))  # one row
    shared = lambda s: presented(of(found, s), SETS[s], whole)
    codes = of(found, "unmapped").withColumns({"platform_key": F.col("free.platform_key"), "platform_product_code": F.col("free.platform_product_code")})
    return {
        "overall": of(found, "overall").select(*blocks(compare)), "platform": daily.platform_rows(shared("platform"), channels), "shop": daily.shop_rows(shared("shop"), channels),
        "category": daily.category_rows(shared("category")), "sku": daily.sku_rows(of(found, "sku").drop("category"), skus, compare), "unmapped": daily.unmapped_rows(codes, compare),
    }


def listed(found: DataFrame, channels: DataFrame, skus: DataFrame) -> DataFrame:
    """All sections but the total in one table; columns that a section lacks are NULL."""
    out = None
    for section, rows in parts(found, channels, skus).items():
        if section == "overall":
            continue
        one = rows.withColumn("section", F.lit(section))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
