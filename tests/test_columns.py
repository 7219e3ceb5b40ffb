"""Casting, names, formulas and filters against known values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import formula
from tallyhouse.functions.columns import day, money, normal_name, similarity, whole_number
from tallyhouse.operators import identity
from tallyhouse.operators.normalize import cast_field, passes
from tallyhouse.schema import SKUS, RetailError


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("1,234.56", "1234.56"), ("￥1234", "1234"), ("-", "0"), ("--", "0"), ("", "0"), ("0.00", "0"), ("-12.5", "-12.5"), ("1.23e3", "1230"), ("99元", "99"), ("1.005", "1.00"), ("1.015", "1.02"), (None, "0")])
def test_money(spark, text, want):
    got = one(spark, text, cast_field(F.col("x"), {"type": "money", "strip_chars": [",", "￥", "元"], "unit": "yuan", "default": "0"})[0])
    assert (got.value, got.failed) == (Decimal(want).quantize(Decimal("0.01")), False)


@pytest.mark.parametrize("text", ["abc", "1d", "nan", "inf", "1e400", "12 3"])
def test_bad_money(spark, text):
    assert one(spark, text, money(F.col("x"))).failed


def test_fen_and_integers(spark):
    assert one(spark, "12345", money(F.col("x"), "fen")).value == Decimal("123.45")
    for text, want in (("12.6", 13), ("12.4", 12), ("-12.5", -13), ("12.5", 13)):
        assert one(spark, text, whole_number(F.col("x"))).value == want
    assert one(spark, "-", whole_number(F.col("x"))).value is None


@pytest.mark.parametrize(("text", "want"), [("2026-09-06 13:24:35", "2026-09-06"), ("2026-09-06", "2026-09-06"), ("2026/09/06", "2026-09-06"), ("2026/9/6", "2026-09-06"), ("20260906", "2026-09-06"), ("45358", "2024-03-07"), ("45358.5", "2024-03-07")])
def test_dates(spark, text, want):
    got = one(spark, text, day(F.col("x"), ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d"]))
    assert str(got.value) == want and not got.failed


def test_bad_date(spark):
    got = one(spark, "not-a-date", day(F.col("x"), ["%Y-%m-%d"]))
    assert got.value is None and got.failed


def test_names(spark):
    assert one(spark, "胶原蛋白(礼盒)【正品】面霜", normal_name(F.col("x"))) == "胶原蛋白面霜"
    assert one(spark, " A  100ML ", normal_name(F.col("x"))) == "a 100"
    rows = [("玻尿酸精华液", "玻尿酸补水精华液", 85.7143), ("abc", "abd", 66.6667), ("b a", "a b", 100.0), ("", "x", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select("want", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.want - r.s) < 1e-3 for r in got)


def test_formula(spark):
    df = spark.createDataFrame([(Decimal("10.00"), None, 4)], "gmv decimal(14,2), refund_amount decimal(14,2), paid_qty long")
    value = lambda f: df.select(formula.compiled(f).alias("v")).first().v
    assert value("gmv - refund_amount") == 10 and value("-gmv + 2 * paid_qty") == -2 and value("gmv / paid_qty") == Decimal("2.5") and value("gmv / refund_amount") is None


@pytest.mark.parametrize("text", ["__import__('os')", "gmv.real", "gmv[0]", "True", "'a'", "gmv ** 2", "gmv // 2", "~gmv", "sku_id", "gmv -", "lambda: 1", "gmv if gmv else 1"])
def test_formula_refuses(text):
    with pytest.raises(RetailError):
        formula.compiled(text)


VALUES = [None, "", "5", "abc", "10"]


@pytest.mark.parametrize(("op", "extra", "want"), [
    ("not_null", {}, "5,abc,10"), ("is_null", {}, "None,"), ("numeric", {}, "5,10"), ("in", {"values": ["5", ""]}, ",5"), ("not_in", {"values": ["5", ""]}, "None,abc,10"), ("contains", {"values": ["b", "1"]}, "abc,10"),
    ("not_contains", {"values": ["b", "1"]}, "None,,5"), ("gt", {"value": 5}, "10"), ("gte", {"value": 5}, "5,10"), ("lt", {"value": 10}, "5"), ("lte", {"value": "10"}, "5,10"), ("eq", {"value": 5}, "5"), ("neq", {"value": 5}, "None,,abc,10"),
])
def test_filters(spark, op, extra, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, x string")
    got = df.where(passes(F.col("x"), {"op": op, **extra})).orderBy("i").collect()
    assert ",".join(str(r.x) for r in got) == want


def plain_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, above = [0], row
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[-1], above[j + 1]))
    return 200 * row[-1] / (len(a) + len(b))


def test_candidates_against_all_pairs(spark):
    """The prefix filter loses no pair: the best three by brute force, ties by SKU."""
    rng = random.Random(1)
    name = lambda: "".join(rng.choices("abcde", k=rng.randint(3, 9)))
    skus = [(i, f"S{i}", name(), "c1" if i < 20 else "c2", None, None, "active" if i % 9 else "inactive") for i in range(40)]
    skus += [(100 + i, f"T{i}", skus[i][2], "c2", None, None, "active") for i in range(5)]
    products = [(f"p{i}", name() if i % 3 else skus[i][2], rng.choice(["c1", "c2", "c3", None])) for i in range(40)]
    got = {(r.code, r["rank"]): (r.sku_id, round(r.score, 6)) for r in identity.candidates(spark.createDataFrame(products, "code string, product_name string, category string"), spark.createDataFrame(skus, SKUS)).collect()}
    want = {}
    live = [s for s in skus if s[6] == "active"]
    for code, text, category in products:
        own = [s for s in live if s[3] == category]
        found = sorted((-plain_similarity(text, s[2]), s[0]) for s in (own if category and len(own) >= 5 else live) if plain_similarity(text, s[2]) >= 75 - 1e-9)[:3]
        want |= {(code, n): (i, round(-x, 6)) for n, (x, i) in enumerate(found, 1)}
    assert got == want and len(want) > 20
