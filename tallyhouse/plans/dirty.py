"""A channel's raw file over the order tables, with dirt at known rows, and the cleaning queries that run on it.

Every line item is a row of text cells. Its dirt follows from its number, so that the values a cell should give are
known without parsing it: the SQL that these queries are held against starts from the values, not from the text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import formula
from tallyhouse.functions.columns import clean_text, day, money, normal_name, whole_number
from tallyhouse.operators import identity
from tallyhouse.operators.normalize import Normalised, loose_number, merge_rows, normalise, passes, typed
from tallyhouse.plans import bridge, listing
from tallyhouse.session import stored
from tallyhouse.sources import spec

#: Numbers of a row and its cells, in SQL for either engine: {div} is the whole-number division, {text} the text type, {serial} days since 1899-12-30.
#: Order and line number alone repeat; with supplier and part they tell rows apart.
NUMBERS = {
    "n": "(CAST(l_suppkey AS BIGINT) * 100000 + l_partkey) * 100000000 + l_orderkey * 10 + l_linenumber", "d": "make_date(year(l_shipdate), month(l_shipdate), 1)", "cents": "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT)", "q": "CAST(l_quantity AS BIGINT)",
    "r3": "(l_orderkey * 7 + l_linenumber * 3) % 5000", "product": "l_partkey % 50", "shop": "l_suppkey % 10",
}
CELLS = {
    "统计日期": "CASE WHEN n % 97 = 0 THEN 'not-a-date' WHEN n % 101 = 0 THEN ' ' WHEN n % 5 = 0 THEN concat(year(d), '-', lpad(CAST(month(d) AS {text}), 2, '0'), '-01 13:24:35') WHEN n % 5 = 1 THEN concat(year(d), '/', month(d), '/1') WHEN n % 5 = 2 THEN concat(year(d), lpad(CAST(month(d) AS {text}), 2, '0'), '01') WHEN n % 5 = 3 THEN CAST({serial} AS {text}) ELSE concat(year(d), '-', lpad(CAST(month(d) AS {text}), 2, '0'), '-01') END",
    "店铺名称": "CASE WHEN n % 13 = 0 THEN '' ELSE concat(' 店', shop, ' ') END",
    "商品ID": "concat('''', product, CASE WHEN n % 2 = 0 THEN ' ' ELSE '' END)",
    "商品名称": "CASE WHEN n % 89 = 0 THEN '测试品' WHEN n % 83 = 0 THEN '夏季赠品' WHEN n % 3 = 0 THEN '' ELSE concat('品', n % 7) END",
    "一级类目": "CASE WHEN n % 4 = 0 THEN ' ' ELSE concat('类', product % 5) END",
    "支付金额": "CASE WHEN n % 67 = 0 THEN 'N/A' WHEN n % 31 = 0 THEN '-' WHEN n % 29 = 0 THEN '' WHEN n % 7 = 0 THEN concat('￥', CASE WHEN cents >= 100000 THEN concat(cents {div} 100000, ',', lpad(CAST(cents {div} 100 % 1000 AS {text}), 3, '0')) ELSE CAST(cents {div} 100 AS {text}) END, '.', lpad(CAST(cents % 100 AS {text}), 2, '0')) WHEN n % 11 = 0 THEN concat(cents {div} 100, '.', lpad(CAST(cents % 100 AS {text}), 2, '0'), '元') ELSE concat(cents {div} 100, '.', lpad(CAST(cents % 100 AS {text}), 2, '0')) END",
    "支付件数": "CASE WHEN n % 9 = 0 THEN concat(q, '.5') WHEN n % 6 = 0 THEN concat(q, '件') WHEN n % 23 = 0 THEN '--' ELSE CAST(q AS {text}) END",
    "退款金额": "concat(r3 {div} 1000, '.', lpad(CAST(r3 % 1000 AS {text}), 3, '0'))",
    "商品访客数": "CASE WHEN n % 19 = 0 THEN '-' ELSE concat(1 + q {div} 10, ',', lpad(CAST(q AS {text}), 3, '0')) END",
    "支付买家数": "CASE WHEN n % 21 = 0 THEN 'abc' ELSE CAST(q AS {text}) END",
    "推广花费": "CASE WHEN n % 10 = 0 THEN '' ELSE concat('¥', n % 1000 {div} 100, '.', lpad(CAST(n % 100 AS {text}), 2, '0')) END",
}
TEXT = "CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '' WHEN n % 3 = 0 THEN concat('ab', n % 10) ELSE CAST(n % 20 AS {text}) END"
FILTERS = {
    "not_null": {}, "is_null": {}, "numeric": {}, "in": {"values": ["5", "ab3", ""]}, "not_in": {"values": ["5", "ab3", ""]}, "contains": {"values": ["b1", "5"]}, "not_contains": {"values": ["b1", "5"]},
    "gt": {"value": 9}, "gte": {"value": "9"}, "lt": {"value": 5}, "lte": {"value": 5}, "eq": {"value": 7}, "neq": {"value": 7},
}
KEYS = ["stat_date", "platform_key", "platform_product_code", "shop_code"]
OUT = ["row_no", "stat_date", "shop_code", "platform_product_code"]


def _spark(sql: str) -> str:
    return sql.format(div="div", text="STRING", serial="datediff(d, DATE '1899-12-30')")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has: the casts that follow cost far more than the scan, whose row groups may be few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = bridge.read(spark, sf_dir, "lineitem")
    return dealt(li.selectExpr(*[f"{e} AS {c}" for c, e in NUMBERS.items()]), "n")


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], spec.Spec]:
    """row_no and cells, the header and the channel's specification."""
    cells = F.array(*[F.expr(_spark(e)) for e in CELLS.values()])
    return numbered(spark, sf_dir).select(F.col("n").alias("row_no"), cells.alias("cells")), list(CELLS), spec.builtin("taobao")


def cleaned(spark: SparkSession, sf_dir: str, texts: bool = False) -> Normalised:
    """texts: the rows' raw texts are wanted. The cast rows are written once and read by each step that follows."""
    rows, header, own = raw(spark, sf_dir)
    keep = stored if texts else lambda cast: stored(cast.drop("raw")).withColumn("raw", F.lit(None).cast("string"))
    return normalise(rows, header, own, keep=keep)


def _cells(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return numbered(spark, sf_dir).select(F.col("n").alias("row_no"), *[F.expr(_spark(CELLS[c])).alias(c) for c in names])


def facts(spark, d):
    return cleaned(spark, d).facts.drop("upload_id", "raw_row_json", "sku_id")


def errors(spark, d):
    return cleaned(spark, d).errors.select("row_number", "error_type", "error_message")


def snapshots(spark, d):
    return cleaned(spark, d, texts=True).facts.select("row_no", "raw_row_json")


def stats(spark, d):
    """total, valid, filtered, duplicated and failed; failed counts errors, not rows."""
    return cleaned(spark, d).counts()


def merged(strategy: str):
    def run(spark, d):
        rows, header, own = raw(spark, d)
        good = typed(rows, header, own).where(F.size("_errors") == 0).drop("_errors", "raw")
        if strategy == "sum":
            good = stored(good)
        return merge_rows(good, replace(own, dedup={**own.dedup, "strategy": strategy})).select(*OUT, "product_name", "gmv", "paid_qty", "visitors")

    return run


def group_sizes(spark, d):
    """How many rows share a key, by size."""
    rows, header, own = raw(spark, d)
    good = typed(rows, header, own).where(F.size("_errors") == 0)
    return good.groupBy(*own.dedup["keys"]).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def filtered(op: str):
    return lambda spark, d: numbered(spark, d).select("n", F.expr(_spark(TEXT)).alias("x")).where(passes(F.col("x"), {"op": op, **FILTERS[op]}))


def money_cast(spark, d):
    rule = spec.builtin("taobao").transforms["gmv"]
    from tallyhouse.operators.normalize import cast_field

    cast = _cells(spark, d, "支付金额", "退款金额").select("row_no", cast_field(F.col("支付金额"), rule)[0].alias("a"), money(F.col("退款金额")).alias("b"), money(F.col("退款金额"), "fen").alias("c"))
    return cast.select("row_no", F.col("a.value").alias("gmv"), F.col("a.failed").alias("gmv_failed"), F.col("b.value").alias("refund"), F.col("c.value").alias("refund_fen"))


def integer_half_up(spark, d):
    got = _cells(spark, d, "支付件数").select("row_no", whole_number(F.translate("支付件数", "件", ""), "0").alias("a"), whole_number(F.concat(F.lit("-"), F.translate("支付件数", "件-", ""))).alias("b"))
    return got.select("row_no", F.col("a.value").alias("qty"), F.col("b.value").alias("negative"))


def loose_numbers(spark, d):
    """Fields without a transform: signs of money and separators go, placeholders are NULL."""
    got = _cells(spark, d, "支付金额", "商品访客数").select("row_no", loose_number(F.col("支付金额"), "money").alias("a"), loose_number(F.col("商品访客数"), "count").alias("b"))
    return got.select("row_no", F.col("a.value").alias("gmv"), F.col("a.failed").alias("failed"), F.col("b.value").alias("visitors"))


def date_formats(spark, d):
    got = _cells(spark, d, "统计日期").select("row_no", day(F.col("统计日期"), spec.builtin("taobao").transforms["stat_date"]["formats"]).alias("a"))
    return got.select("row_no", F.col("a.value").alias("stat_date"), F.col("a.failed").alias("failed"))


def excel_serial(spark, d):
    got = numbered(spark, d).select(F.col("n").alias("row_no"), day(F.expr(_spark("concat({serial}, '.', n % 10)")), ["%Y-%m-%d"]).alias("a"))
    return got.select("row_no", F.col("a.value").alias("stat_date"))


def shop_fallback(spark, d):
    rows, header, own = raw(spark, d)
    return typed(rows, header, own).groupBy("shop_code").agg(F.count("*").alias("n"), F.count("shop_name").alias("named"))


def string_clean(spark, d):
    return _cells(spark, d, "商品ID", "一级类目").select("row_no", clean_text(F.col("商品ID"), [" ", "\t", "'"]).alias("code"), clean_text(F.col("一级类目")).alias("category"))


def name_normalize(spark, d):
    name = F.concat(F.lit("【新款】"), "p_name", F.lit(" (100ML) "), F.upper("p_name"), F.lit("  正品包邮[x]（y）"))
    return bridge.read(spark, d, "part").select("p_partkey", normal_name(name).alias("name"))


def net_formula(spark, d):
    f = bridge.facts(spark, d).withColumn("refund_amount", F.when(F.col("row_no") != 3, F.col("refund_amount")))
    return f.select("upload_id", "row_no", F.bround(formula.compiled("gmv - refund_amount - 2 * ad_cost"), 2).try_cast("decimal(14,2)").alias("net"), F.round(formula.compiled("gmv / (paid_qty - 1)").cast("double"), 6).alias("unit"))


def parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes, mappings and SKUs over the parts: a third of the codes are those of SKUs, some are mapped, some SKUs are not active."""
    part = bridge.read(spark, d, "part")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("K"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("platform_product_code")
    channel = F.element_at(F.array(*[F.lit(c[0]) for c in bridge.CHANNEL_ROWS]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("platform_key")
    codes = part.select(channel, code)
    mapped = F.when(F.col("p_partkey") % 14 != 0, F.col("p_partkey") + 1)
    mappings = part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), channel, code, F.col("p_name").alias("platform_product_name"), mapped.alias("sku_id"), F.when(mapped.isNotNull(), "manual").otherwise("unmapped").alias("match_type"), F.when(mapped.isNotNull(), 1).otherwise(0).cast("decimal(5,4)").alias("confidence"))
    skus = bridge.skus(spark, d).withColumn("status", F.when(F.col("id") % 11 == 0, "inactive").otherwise("active"))
    return codes, mappings, skus


def sku_match(spark, d):
    return identity.match_codes(*parts(spark, d))


def exact_sku_match(spark, d):
    return sku_match(spark, d).where("match_type = 'exact'").select("platform_key", "platform_product_code", "sku_id")


def mapping_lookup(spark, d):
    return sku_match(spark, d).where("match_type = 'mapping'").select("platform_key", "platform_product_code", "sku_id")


def mapping_stats(spark, d):
    return identity.match_counts(sku_match(spark, d), "platform_key")


def mapping_upsert(spark, d):
    """Codes found by exact match are written over the mappings; a NULL never clears a confirmed one, a blank name keeps the old."""
    codes, mappings, skus = parts(spark, d)
    found = identity.match_codes(codes, mappings.limit(0), skus).where("platform_key <> 'jd'")
    changes = found.select("platform_key", "platform_product_code", F.when(F.col("sku_id") % 2 == 0, F.lit("new")).otherwise("").alias("platform_product_name"), "sku_id", "match_type", F.lit(1).cast("decimal(5,4)").alias("confidence"))
    return identity.upserted(mappings, changes).select("platform_key", "platform_product_code", "platform_product_name", "sku_id", "match_type")


def upsert_ids(spark, d):
    """Numbers of old mappings stay, new ones go on without gaps."""
    codes, mappings, skus = parts(spark, d)
    changes = codes.select("platform_key", "platform_product_code", F.lit("x").alias("platform_product_name"), F.lit(None).cast("long").alias("sku_id"), F.lit("unmapped").alias("match_type"), F.lit(0).cast("decimal(5,4)").alias("confidence"))
    return identity.upserted(mappings, changes).select("id")


def mapping_listing(spark, d):
    """Mappings with the code and name of their SKU."""
    _, mappings, skus = parts(spark, d)
    return listing.with_skus(mappings, skus).select("platform_key", "platform_product_code", "sku_id", "sku_code", "sku_name")


def missing_skus(spark, d):
    """SKU numbers that mappings name and no record has."""
    _, mappings, skus = parts(spark, d)
    named = mappings.where("sku_id is not null").select(F.col("sku_id").alias("id")).distinct()
    return listing.missing(named, skus).select(F.col("id").alias("sku_id"))


def like_search(spark, d):
    return listing.searched(parts(spark, d)[2], name="E%1", sku_code="k_7").select("id", "sku_code", "name")


def page_listing(spark, d):
    """The third page of twenty active SKUs by number."""
    return listing.page(parts(spark, d)[2].where("status = 'active'"), [F.asc("id")], 3, 20).select("id", "sku_code")


def page_after(spark, d):
    """The sixty SKUs that follow SKU 44, which is not active: by status, then by number, those without a status last."""
    skus = parts(spark, d)[2].withColumn("status", F.when(F.col("id") % 13 != 0, F.col("status")))
    return listing.after(skus, [("status", True), ("id", False)], ("inactive", 44), 60).select("id", "sku_code", "status")


def fuzzy_candidates(spark, d):
    """Likely SKUs of products whose names are those of parts with a word put in or changed."""
    part = bridge.read(spark, d, "part").where("p_partkey % 5 = 0")
    products = part.select(F.col("p_partkey").alias("product"), F.concat("p_name", F.lit(" "), F.substring("p_brand", -2, 2)).alias("product_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("category"))
    return identity.candidates(products, parts(spark, d)[2])


QUERIES = {
    "normalise_facts": facts, "normalise_errors": errors, "normalise_stats": stats, "raw_json_snapshot": snapshots, "dedup_sum": merged("sum"), "dedup_first": merged("first"), "dedup_last": merged("last"), "dedup_group_sizes": group_sizes,
    **{f"filter_{op}": filtered(op) for op in FILTERS}, "money_cast": money_cast, "integer_half_up": integer_half_up, "loose_numbers": loose_numbers, "date_multi_format": date_formats, "excel_serial": excel_serial, "shop_fallback": shop_fallback,
    "string_clean": string_clean, "name_normalize": name_normalize, "net_formula": net_formula, "sku_match": sku_match, "exact_sku_match": exact_sku_match, "mapping_lookup": mapping_lookup, "mapping_stats": mapping_stats, "mapping_upsert": mapping_upsert,
    "upsert_ids": upsert_ids, "mapping_listing": mapping_listing, "missing_skus": missing_skus, "like_search": like_search, "page_listing": page_listing, "page_after": page_after, "fuzzy_candidates": fuzzy_candidates,
}
