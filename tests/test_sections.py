"""Sections of a report from one pass, lists, and counts observed by writes."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.functions.columns import similarity
from tallyhouse.operators import anomaly
from tallyhouse.operators.metrics import with_costs
from tallyhouse.operators.normalize import cast_counts, error_counts, normalise, observed_stats
from tallyhouse.plans import bridge, daily, listing, sections
from tallyhouse.schema import FACTS
from tallyhouse.sources import spec
from tallyhouse.store import Store

DAY = dt.date(2026, 9, 6)
FIELDS = "upload_id long, row_no long, stat_date date, platform_key string, shop_code string, shop_name string, platform_product_code string, product_name string, category string, sku_id long, order_qty long, paid_qty long, gmv decimal(14,2), refund_amount decimal(14,2), net_amount decimal(14,2), visitors long, buyers long, ad_cost decimal(14,2)"


def sold(spark, n=400, seed=5):
    """Rows with NULL in every key, days in and out of the compared ones, products with and without SKU."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        code = rng.choice("ABCDEF")
        sku = rng.choice([None, ord(code) - 64]) if code < "E" else None
        money = Decimal(rng.randint(0, 99999)) / 100
        rows.append((i % 7, i, DAY - dt.timedelta(days=rng.choice([0, 0, 0, 1, 1, 2, 7])), rng.choice(["jd", "taobao", None]), rng.choice(["s1", "__UNKNOWN__"]), rng.choice([None, "店"]), code, rng.choice([None, "名"]), rng.choice([None, "", "类"]), sku,
                     None, rng.randint(0, 9), rng.choice([None, money]), Decimal(1), money, rng.randint(0, 50), rng.choice([None, 3]), rng.choice([None, Decimal("2.50")])))
    skus = spark.createDataFrame([(1, "A", "甲", "类", None, Decimal("1.10"), "active"), (2, "B", "乙", None, None, None, "active")], "id long, sku_code string, name string, category string, brand string, cost_price decimal(14,2), status string")
    channels = bridge.channels(spark)
    return with_costs(spark.createDataFrame(rows, FIELDS), skus, channels), skus, channels


def same(a, b):
    got, want = (sorted(map(repr, x.select(*b.columns).collect())) for x in (a, b))
    assert got == want and set(a.columns) == set(b.columns)
    return len(got)


def test_sections_are_those_of_a_pass_each(spark):
    facts, skus, channels = sold(spark)
    sums = sections.sums(facts, channels, DAY).cache()
    for compare in (True, False):
        part = sections.parts(sums, channels, skus, compare)
        assert same(part["overall"], daily.overall(facts, DAY, compare)) == 1
        assert same(part["sku"], daily.by_sku(facts, skus, channels, DAY, compare)) == 4
        assert same(part["unmapped"], daily.by_unmapped(facts, DAY, compare)) > 6
    assert same(part["platform"], daily.by_platform(facts, channels, DAY)) == 3
    assert same(part["shop"], daily.by_shop(facts, channels, DAY)) == 12
    assert same(part["category"], daily.by_category(facts, DAY)) == 3
    assert same(daily.values_of(sections.of(sums, "overall")), daily.overall_values(facts, DAY)) == 16
    for scope, section, keys, rows in (("overall", "overall", [], facts), ("platform", "platform", ["platform_key"], facts), ("sku", "sku", ["sku_id"], facts.where("sku_id is not null"))):
        subject = F.col(keys[0]).cast("string") if keys else F.lit("整体")
        same(anomaly.subjects_of(sections.of(sums, section), scope, subject), anomaly.subjects(rows, scope, keys, subject, DAY))
    sums.unpersist()


def test_sections_of_nothing(spark):
    facts, skus, channels = sold(spark)
    sums = sections.sums(facts.limit(0), channels, DAY)
    part = sections.parts(sums, channels, skus)
    assert {k: v.count() for k, v in part.items()} == {"overall": 0, "platform": 0, "shop": 0, "category": 0, "sku": 0, "unmapped": 0}
    other = sections.sums(facts.where(F.col("stat_date") != F.lit(DAY)), channels, DAY)
    assert [r.section for r in other.collect()] == ["overall"]


def test_sections_scan_once(spark, sf_dir):
    channels = bridge.channels(spark)
    facts = with_costs(bridge.facts(spark, sf_dir), bridge.skus(spark, sf_dir), channels)
    plan = sections.sums(facts, channels, bridge.DAY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_shipdate#") and sum("FileScan parquet" in line and "l_shipdate" in line for line in plan.splitlines()) == 1
    assert sum("Expand" in line for line in plan.splitlines()) == 1 and plan.count("hashpartitioning(") == 1 + plan.count("SortMergeJoin") * 2


def test_seek_pages(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, id long").repartition(5)
    for falls in (True, False):
        order = [("c", falls), ("id", not falls)]
        want = [tuple(r) for r in df.orderBy(*[F.desc_nulls_last(c) if f else F.asc_nulls_last(c) for c, f in order]).collect()]
        got, last = [], None
        while some := [tuple(r) for r in listing.after(df, order, last, 7).collect()]:
            got, last = got + some, some[-1]
        assert got == want
    assert listing.after(df, [("id", False)], (59,), 5).count() == 0


def test_writes_observe_what_statistics_count(spark, tmp_path):
    own, store = spec.builtin("taobao"), Store(spark, f"file://{tmp_path}")
    header = ["统计日期", "店铺名称", "商品ID", "商品名称", "一级类目", "支付金额", "支付件数", "退款金额", "商品访客数", "支付买家数", "推广花费"]
    line = lambda day, code, name, gmv, buyers: [day, "店", code, name, "美妆", gmv, "1", "0", "1", buyers, "0"]
    good = [line("2026-09-06", f"K{i % 4}", "品", "1", "1") for i in range(9)]
    bad = [line("x", "K9", "品", "N/A", "1"), line("", "K9", "品", "1", "1"), line("2026-09-06", "K8", "测试品", "1", "1"), line("2026-09-06", "K7", "品", "", "1"), line("2026-09-06", "K7", "品", "1", "abc")]
    for rows in (good + bad, good[:4], bad, []):
        raw = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_no long, cells array<string>")
        cast = {}
        done = normalise(raw, header, own, 3, lambda df: store.staged("staging/3", df, cast_counts(), cast))
        seen = store.put_upload("upload_errors", 3, done.errors, error_counts())
        sums = store.put_upload("sales_facts", 3, done.facts.select(*[F.col(f.name) for f in FACTS]), {"last": F.max("stat_date")})
        stats = done.stats()
        assert observed_stats(cast, seen) == stats and sums["rows"] == stats["valid"] and stats["total"] == len(rows)
        assert store.table("sales_facts").count() == stats["valid"] and store.table("upload_errors").count() == seen["rows"]


def plain_similarity(a, b):
    a, b = (" ".join(sorted(t for t in x.split(" ") if t)) for x in (a, b))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[-1], above[j + 1]))
    return 200 * row[-1] / (len(a) + len(b))


def test_similarity_by_bits(spark):
    """Against the table in plain Python: about and over the 62 characters of a word, digits, and characters outside the basic plane."""
    rng = random.Random(4)
    text = lambda: "".join(rng.choices("abc01 😀面", k=rng.choice([0, 1, 5, 20, 61, 62, 63, 90])))
    rows = [(text(), text()) for _ in range(300)] + [("x" * 62, "x" * 63), ("x" * 63, "x" * 63), ("", "a"), ("  ", " ")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - plain_similarity(r.a, r.b)) < 1e-9 for r in got)
    assert spark.range(1).select(similarity(F.lit(None).cast("string"), F.lit("a")).alias("s")).first().s == 0
