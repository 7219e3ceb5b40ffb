"""The steps that all cleaning queries share: how rows are dealt, what is merged and counted, and odd cells."""

import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.functions.columns import day, money, ustrip
from tallyhouse.operators.normalize import normalise
from tallyhouse.plans import dirty
from tallyhouse.sources import spec

OWN = spec.builtin("taobao")
HEADER = list(OWN.column_map)


def test_rows_go_over_all_tasks(spark, sf_dir):
    """A scan of one row group was one task, which then cast every cell."""
    assert dirty.numbered(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_casts_have_no_lambdas(spark, sf_dir):
    plan = dirty.shop_fallback(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_a_repeated_row_number_gives_one_fact_a_key(spark):
    cells = lambda code, gmv, day="2024-01-02": [day, "店", code, "名", "类", gmv, "1", "0", "5", "2", "0"]
    rows = [(2, cells("a", "1")), (2, cells("a", "2")), (3, cells("b", "x")), (4, cells("a", "4")), (5, cells("c", "5", " ")), (6, cells("d", "6"))]
    done = normalise(spark.createDataFrame(rows, "row_no long, cells array<string>"), HEADER, OWN)
    facts = sorted((r.row_no, r.platform_product_code, float(r.gmv), '"支付金额":"1"' in r.raw_row_json or '"支付金额":"6"' in r.raw_row_json) for r in done.facts.where("row_no <> 2").collect())
    assert facts == [(6, "d", 6.0, True)]
    assert [(r.row_no, float(r.gmv)) for r in done.facts.where("row_no = 2").collect()] == [(2, 7.0)]
    assert done.stats() == {"total": 6, "valid": 2, "filtered": 1, "duplicated": 2, "failed": 1}


def test_odd_cells(spark):
    dates = {"2024-1-2": dt.date(2024, 1, 2), "2024-01-02 03:04:05": dt.date(2024, 1, 2), "2024/1/2": dt.date(2024, 1, 2), "20240102": dt.date(2024, 1, 2), "45293": dt.date(2024, 1, 2), "45293.75": dt.date(2024, 1, 2), "　2024-01-02 ": dt.date(2024, 1, 2), "2024-13-02": None, "2024-01-02T03:04:05": None, "2024-01": None, "1234567": dt.date(1899, 12, 30) + dt.timedelta(1234567), "99999999": None, "x": None, "--": None}
    got = spark.createDataFrame([(t,) for t in dates], "t string").select("t", day(F.col("t"), OWN.transforms["stat_date"]["formats"]).alias("d")).collect()
    assert {r.t: r.d.value for r in got} == dates and {r.t for r in got if r.d.failed} == {t for t, d in dates.items() if d is None} - {"--"}
    sums = {"1e25": None, "1e27": None, "NaN": None, "Infinity": None, "1d": None, "　1.005": "1.00", "-0.015": "-0.02", "-": None, " 2 ": "2.00"}
    got = spark.createDataFrame([(t,) for t in sums], "t string").select("t", money(F.col("t")).alias("m")).collect()
    assert {r.t: None if r.m.value is None else str(r.m.value) for r in got} == sums and not next(r for r in got if r.t == "-").m.failed
    assert spark.range(1).select(ustrip(F.lit("   a​ b \n"))).first()[0] == "a​ b"
