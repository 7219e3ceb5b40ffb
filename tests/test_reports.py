"""Golden values of daily and weekly reports."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import anomaly, attribution
from tallyhouse.operators.metrics import with_costs
from tallyhouse.plans import daily, weekly
from tallyhouse.schema import CHANNELS, FACTS, SKUS

D0 = dt.date(2026, 9, 6)


def facts(spark, rows):
    out = []
    for i, r in enumerate(rows):
        r = {"upload_id": 1, "row_no": i, "shop_code": "S1", "shop_name": "店铺一", "category": "美妆", "product_name": "p", **r}
        for k in ("gmv", "refund_amount", "ad_cost"):
            r[k] = None if r.get(k) is None else Decimal(str(r[k]))
        r["net_amount"] = r["gmv"] - (r["refund_amount"] or 0)
        out.append(tuple(r.get(f.name) for f in FACTS))
    return spark.createDataFrame(out, FACTS)


def channels(spark, fee="0", piece="0"):
    return spark.createDataFrame([(k, n, Decimal(fee), Decimal(piece), s) for k, n, s in (("taobao", "淘宝", False), ("doudian", "抖店", False), ("pinduoduo", "拼多多", False), ("jd", "京东", True))], CHANNELS)


ROWS = [
    dict(stat_date=D0, platform_key="taobao", platform_product_code="A1", gmv=1000, refund_amount=100, paid_qty=10, buyers=8, visitors=200, ad_cost=50, sku_id=1),
    dict(stat_date=dt.date(2026, 9, 5), platform_key="taobao", platform_product_code="A1", gmv=800, refund_amount=80, paid_qty=8, buyers=6, visitors=160, sku_id=1),
    dict(stat_date=dt.date(2026, 8, 30), platform_key="taobao", platform_product_code="A1", gmv=500, refund_amount=50, paid_qty=5, buyers=4, visitors=100, sku_id=1),
    dict(stat_date=D0, platform_key="doudian", platform_product_code="B1", gmv=300, refund_amount=0, paid_qty=3, buyers=3, visitors=60, shop_code="S2", shop_name="店铺二", category="食品"),
    dict(stat_date=dt.date(2026, 8, 30), platform_key="pinduoduo", platform_product_code="C1", gmv=999, paid_qty=1, buyers=1, visitors=1),
]


@pytest.fixture(scope="module")
def known(spark):
    sku = spark.createDataFrame([(1, "K1", "面霜", "美妆", None, Decimal("30"), "active")], SKUS)
    return with_costs(facts(spark, ROWS), sku, channels(spark)).cache()


def test_overview(known):
    o = daily.overall(known, D0).first()
    assert (o.gmv, o.net_amount, o.refund_amount) == (1300, 1200, 100)
    assert (o.gmv_dod, o.gmv_wow) == (0.625, -0.1328)
    assert (o.refund_rate, o.conversion_rate, o.avg_order_value) == (0.0769, round(11 / 260, 4), 109.09)
    assert (o.refund_rate_dod_pp, o.conversion_rate_dod_pp) == (-2.3077, 0.4808)
    assert o.roi == 24.0 and daily.overall(known, D0, compare=False).first().gmv_dod is None


def test_platforms_and_profit(spark, known):
    rows = daily.by_platform(known, channels(spark), D0).orderBy(F.desc("net_amount")).collect()
    assert [(r.platform_key, r.share) for r in rows] == [("taobao", 0.75), ("doudian", 0.25)]
    assert rows[1].gmv_dod is None
    o = daily.overall(known, D0).first()
    assert (o.gross_profit, o.gross_margin, o.operating_profit, o.gross_profit_dod) == (600, 0.6667, 550, 0.25)
    assert daily.cost_coverage(known, D0).first()[0] == 0.75
    assert {r.platform_key for r in daily.missing_platforms(known, channels(spark), D0).collect()} == {"jd", "pinduoduo"}


def test_fees(spark):
    sku = spark.createDataFrame([(1, "K1", "面霜", "美妆", None, Decimal("30"), "active")], SKUS)
    o = daily.overall(with_costs(facts(spark, ROWS), sku, channels(spark, "0.1", "2")), D0).first()
    assert (o.gross_profit, o.operating_profit) == (490, 440)


def test_no_costs(spark):
    none = spark.createDataFrame([], SKUS)
    f = with_costs(facts(spark, ROWS), none, channels(spark))
    o = daily.overall(f, D0).first()
    assert o.gross_profit is None and o.operating_profit is None and daily.cost_coverage(f, D0).first()[0] == 0.0


def test_rolling_refund(spark):
    days = [dict(stat_date=D0 - dt.timedelta(days=i), platform_key="taobao", platform_product_code="A", gmv=1000 if i else 100, refund_amount=100 if i else 200) for i in range(7)]
    assert daily.rolling_refund(facts(spark, days), D0).first()[0] == round(800 / 6100, 4)


def test_null_dimensions(spark):
    rows = [dict(stat_date=D0 - dt.timedelta(days=i), platform_key="taobao", platform_product_code="A", gmv=100 + i, refund_amount=0, category=None, shop_code=None, shop_name=None) for i in (0, 1)]
    f = with_costs(facts(spark, rows), spark.createDataFrame([], SKUS), channels(spark))
    c = daily.by_category(f, D0).first()
    assert c.display == "未分类" and c.gmv_dod is not None
    assert daily.by_shop(f, channels(spark), D0).first().display == "淘宝 · 未命名店铺"


def test_skus_and_trend(spark, known):
    sku = spark.createDataFrame([], SKUS)
    r = daily.by_sku(known, sku, channels(spark), D0).first()
    assert (r.sku_code, r.name, r.platforms, r.category) == ("1", "SKU#1", "淘宝", "美妆")
    u = daily.by_unmapped(known, D0).collect()
    assert [x.platform_product_code for x in u] == ["B1"] and u[0].gmv == 300
    t = daily.trend(known, D0).orderBy("stat_date").collect()
    assert len(t) == 30 and t[-1].gmv == 1300 and t[-3].gmv is None


def test_attribution(spark):
    cols = attribution.contributions(*[F.lit(x) for x in (2500, 500, 25, 5000, 1000, 50)])
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (r.gmv_dod, r.visitors, r.conversion_rate, r.avg_order_value, r.primary_driver) == (-0.5, -0.5, 0.0, 0.0, "visitors")
    none = attribution.contributions(*[F.lit(x) for x in (2500, 0, 25, 5000, 1000, 50)])
    assert spark.range(1).select(none["gmv_dod"]).first()[0] is None


@pytest.mark.parametrize(("value", "severity"), [(-0.41, "warning"), (-0.60, "warning"), (-0.79, "warning"), (-0.80, "warning"), (-0.81, "critical"), (-0.95, "critical")])
def test_severity(spark, value, severity):
    context = spark.createDataFrame([("sku", "K1 x", "gmv_dod", value, 600.0)], "scope string, subject string, metric string, value double, gmv double")
    rules = spark.createDataFrame([(1, "r", "gmv_dod", "sku", "lt", Decimal("-0.4"), Decimal("500"), True)], "id long, name string, metric string, scope string, operator string, threshold decimal(14,4), min_base decimal(14,2), enabled boolean")
    got = anomaly.alerts(context, rules).first()
    assert got.severity == severity and got.message == f"K1 x GMV 环比 {value * 100:+.1f}%，低于阈值 -40%"
    assert anomaly.alerts(context.withColumn("gmv", F.lit(1.0)), rules).count() == 0


def test_weekly(spark):
    rows = [dict(stat_date=dt.date(2026, 9, d), platform_key="taobao", platform_product_code=f"A{d}", gmv=g, refund_amount=g * 0.1, ad_cost=g * 0.2, paid_qty=10, product_name=f"n{d}") for d, g in ((1, 2000), (2, 3000))]
    f = with_costs(facts(spark, rows), spark.createDataFrame([], SKUS), channels(spark), rounded=False)
    day = dt.date(2026, 9, 2)
    t = weekly.totals(f, day).first()
    assert t.total_gmv == 5000 and t.prev_gmv is None and t.wow_gmv is None and t.total_gross_profit is None and t.total_refund_rate == 0.1
    assert weekly.by_day(f, day).count() == 7 and weekly.by_day(f, day).where("gmv = 0").count() == 5
    assert [r.key for r in weekly.hot_list(f, spark.createDataFrame([], SKUS), channels(spark), day).collect()] == ["A2", "A1"]
    assert weekly.by_platform(f, channels(spark), day).first().share == 1.0
