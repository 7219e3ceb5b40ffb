"""Channel files with known contents, of any size: what the readers, the normaliser and the reports must come to.

A row is its number: channel, day, product and all that is drawn for it follow from a keyed hash of the number, so that
any task makes any row alike, however rows are dealt. The rows hold the values that reading should give; ``cells`` adds
the text of each with the dirt of real exports, ``manifest`` sums the values, and ``files`` puts rows into files of
bounded size, as bytes. All are plans over one range; the driver makes no row.

The dirt: dates in two spellings, money with signs and separators, dashes for missing counts and amounts, and in each
channel a product of a test on the first day, a repeated row on the sixth and an amount that is no number on the
eleventh. Some days sell more, two products crash at the end, three come back often, one channel burns money on
advertising, and another lacks the last day.
"""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.schema import COUNT_FIELDS, MONEY
from tallyhouse.sinks.xlsx import workbook
from tallyhouse.sources import spec

#: The channels' file names, encodings and signs of money, and the texts around their tables.
CHANNELS = {
    "taobao": ("生意参谋_商品效果_{}.csv", "gb18030", "￥"),
    "doudian": ("抖店罗盘_商品数据_{}.csv", "utf-8-sig", ""),
    "pinduoduo": ("拼多多_商品数据_{}.xlsx", "xlsx", "¥"),
    "jd": ("京东商智_商品分析_{}.csv", "utf-8", ""),
}
TITLE, SHEET, FOOTER = "京东商智-商品分析报表（{} 导出）", "商品数据", ["说明：以上数据来源于拼多多商家后台，仅供参考。", "导出时间：{} 08:00    共 {} 行"]
SHOPS = ["旗舰店", "专营店", "工厂店"]
CATEGORIES = ["美妆", "食品", "家居", "服饰", "数码"]
SUMS = ["gmv", "refund_amount", "ad_cost", *COUNT_FIELDS]
#: Rows of a file at most: far under what the readers take.
ROWS_PER_FILE = 100_000
LAST_DAY = dt.date(2026, 9, 6)


def rows(spark: SparkSession, days: int = 35, skus: int = 40, seed: int = 7, last_day: dt.date = LAST_DAY) -> DataFrame:
    """One row for each row of the files: channel, place, kind (plain, test or bad) and the values that reading it gives.

    ``product`` numbers go over the shared products and then those that only one channel has.
    """
    each = skus + max(1, skus // 20)
    keys = list(CHANNELS)
    number = F.col("id")
    r = spark.range(len(keys) * days * each).select(
        "id",
        (number / (days * each)).cast("long").alias("_channel"),
        F.expr(f"id div {each} % {days}").alias("_day"),
        (number % each).alias("product"),
    )
    r = r.withColumn("platform_key", F.get(F.array(*map(F.lit, keys)), F.col("_channel").cast("int"))).where(~((F.col("platform_key") == "jd") & (F.col("_day") == days - 1)))
    product, day, left = F.col("product"), F.col("_day"), days - 1 - F.col("_day")

    def draw(what: str, n: int, *key: Column) -> Column:
        """A whole number under n, from the row's number or another key."""
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *(key or (number,))), F.lit(n))

    crash, often = product < 2, product.between(2, 4)
    price = F.when(crash, 26000).when(often, 12000 + draw("price", 16001, product)).otherwise(3000 + draw("price", 27001, product))
    promo = day.isin(int(days * 0.35), int(days * 0.75))
    burn = (F.col("platform_key") == "doudian") & day.isin(int(days * 0.2), int(days * 0.6), days - 1)
    percent = F.when(crash & (left < 3), F.element_at(F.array(F.lit(15), F.lit(35), F.lit(60)), (left + 1).cast("int"))).when(promo, 300 + draw("promo", 201)).otherwise(100)
    units = F.greatest(F.lit(1), F.expr("(_base * _percent) div 100"))
    part = lambda amount, share: F.expr(f"({amount} * {share}) div 10000")
    cents = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast(MONEY)
    r = r.withColumns({"_price": price, "_base": 5 + draw("base", 56), "_percent": percent}).withColumn("paid_qty", units.cast("long")).withColumns({
        "_gmv": F.col("_price") * F.col("paid_qty"),
        "_refund": F.when(often, 1800 + draw("refund", 1201)).otherwise(draw("refund", 801)),
        "_ad": F.when(burn, 12000 + draw("ad", 3001)).otherwise(300 + draw("ad", 901)),
        "_buyers": F.greatest(F.lit(1), F.expr("paid_qty * 4 div 5")),
        "_dirt": draw("dirt", 100),
        "_first": product == 0,
    })
    r = r.withColumns({"_back": part("_gmv", "_refund"), "_spent": part("_gmv", "_ad"), "_seen": F.col("_buyers") * (10 + draw("seen", 15)) + draw("more", 40)})
    kind = F.when(F.col("_first") & (day == 0), "test").when(F.col("_first") & (day == 10), "bad").otherwise("plain")
    shop = F.get(F.array(*map(F.lit, SHOPS)), (product % len(SHOPS)).cast("int"))
    dealt = r.withColumn("copy", F.explode(F.when(F.col("_first") & (day == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return dealt.select(
        "platform_key",
        day.alias("day"),
        "product",
        "copy",
        kind.alias("kind"),
        F.date_sub(F.lit(last_day), left.cast("int")).alias("stat_date"),
        F.concat(F.col("platform_key"), shop).alias("shop_name"),
        F.when(product < skus, F.concat(F.lit("K"), product)).alias("sku_code"),
        F.concat(F.upper(F.substring("platform_key", 1, 1)), F.lpad(product.cast("string"), 7, "0")).alias("platform_product_code"),
        F.concat(F.when(kind == "test", "测试商品").otherwise(""), F.lit("商品"), product, F.lit("号")).alias("product_name"),
        F.get(F.array(*map(F.lit, CATEGORIES)), (product % len(CATEGORIES)).cast("int")).alias("category"),
        cents("_gmv").alias("gmv"),
        cents("_back").alias("refund_amount"),
        F.when(F.col("_dirt").between(5, 6), F.lit(0)).otherwise(cents("_spent")).cast(MONEY).alias("ad_cost"),
        "paid_qty",
        F.when(F.col("platform_key") == "jd", F.col("paid_qty") + draw("ordered", 3)).alias("order_qty"),
        F.when(F.col("_dirt") >= 3, F.col("_seen")).alias("visitors"),
        F.when(~F.col("_dirt").between(3, 4), F.col("_buyers")).alias("buyers"),
        (draw("slash", 10) == 0).alias("slash"),
    )


def manifest(made: DataFrame) -> DataFrame:
    """By channel and day: rows in the files, rows of test products, of bad amounts, repeated ones, and the sums that the facts must have."""
    good = F.col("kind") == "plain"
    counts = {"rows": F.count("*"), "filtered": F.count_if(F.col("kind") == "test"), "failed": F.count_if(F.col("kind") == "bad"), "duplicated": F.count_if(F.col("copy") > 0)}
    return made.groupBy("platform_key", "stat_date").agg(*[c.alias(n) for n, c in counts.items()], *[F.sum(F.when(good, F.col(c))).alias(c) for c in SUMS])


def cells(made: DataFrame, key: str) -> DataFrame:
    """The rows of a channel with ``cells``, the texts of its columns in the order of its specification."""
    sign, columns = CHANNELS[key][2], list(spec.builtin(key).column_map.values())

    # amounts' texts are a step of their own, so that each is made once; format_number() would take most of a row's time and makes the rare ones only
    amounts = {f"_{c}": F.col(c).cast(MONEY).cast("string") for c in ("gmv", "refund_amount", "ad_cost")}

    def money(c: str) -> Column:
        text = F.col(f"_{c}")
        size = F.length(text)
        small = F.when(text.startswith("-"), None).when(size <= 6, text).when(size <= 9, F.concat(F.left(text, size - 6), F.lit(","), F.right(text, F.lit(6))))
        return F.concat(F.lit(sign), F.coalesce(small, F.format_number(c, 2)))

    dash = lambda c, mark: F.coalesce(F.col(c).cast("string"), F.lit(mark))
    date = F.col("stat_date").cast("string")
    spelt = F.concat(date, F.lit(" 00:00:00")) if key == "doudian" else F.when(F.col("slash"), F.replace(date, F.lit("-"), F.lit("/"))).otherwise(date)
    text = {
        "stat_date": spelt,
        "gmv": F.when(F.col("kind") == "bad", "N/A").otherwise(money("gmv")),
        "refund_amount": money("refund_amount"),
        "ad_cost": F.when(F.col("ad_cost") == 0, "-").otherwise(money("ad_cost")),
        "visitors": dash("visitors", "-"),
        "buyers": dash("buyers", "--"),
        "order_qty": dash("order_qty", ""),
        "paid_qty": F.col("paid_qty").cast("string"),
    }
    spelt_cells = F.array(*[F.coalesce(text.get(c, F.col(c) if c in made.columns else F.lit("")), F.lit("")) for c in columns])
    return made.where(F.col("platform_key") == key).withColumns(amounts).withColumn("cells", spelt_cells).drop(*amounts)


def content(key: str, table: list[list[str]], until: str) -> bytes:
    """A channel's file around its table (header first)."""
    if CHANNELS[key][1] == "xlsx":
        foot = [[t.format(until, len(table) - 1)] for t in FOOTER]
        return workbook([(SHEET, [*table, *foot], ["text"] * len(table[0]))], guard=False)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([[TITLE.format(until)], []] * (key == "jd") + table)
    return out.getvalue().encode(CHANNELS[key][1])


def packed(rows_of: DataFrame, key: str) -> DataFrame:
    """rows_of: file (its number), until (the date in its name), at (the place in it, of any type that has an order) and cells. A row a file: path and content.

    A file is made in one task, from rows that Spark has sorted; callers keep it under ROWS_PER_FILE rows. Files go over
    as many tasks as a shuffle has, since making them costs far more than their rows' bytes tell.
    """
    header = list(spec.builtin(key).column_map)
    name = CHANNELS[key][0]

    def made(group: pa.Table) -> pa.Table:
        file, until = group["file"][0].as_py(), group["until"][0].as_py()
        cells = group["cells"].combine_chunks()
        texts, ends = cells.flatten().to_numpy(zero_copy_only=False).tolist(), (cells.offsets.to_numpy() - cells.offsets[0].as_py()).tolist()
        path = name.format(f"{until.replace('-', '')}_{file:05d}")
        return pa.table({"path": [path], "content": pa.array([content(key, [header, *(texts[i:j] for i, j in pairwise(ends))], until)], pa.binary())})

    tasks = int(rows_of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows_of.select("file", "until", "at", "cells").repartition(tasks, "file").sortWithinPartitions("file", "at")
    return ordered.select("file", "until", "cells").groupBy("file").applyInArrow(made, "path string, content binary")


def files(made: DataFrame, days: int = 35, skus: int = 40) -> DataFrame:
    """Files of all channels, a row each: path, content and sha256. A file holds whole days, or a part of one day's products."""
    each = skus + max(1, skus // 20)
    days_each, products_each = max(1, ROWS_PER_FILE // each), min(each, ROWS_PER_FILE)
    parts = -(-each // products_each)
    out = None
    for key in CHANNELS:
        placed = cells(made, key).select(
            F.expr(f"day div {days_each} * {parts} + product div {products_each}").alias("file"),
            (F.col("day") * (2 * each) + F.col("copy") * each + F.col("product")).alias("at"),
            F.date_format(F.date_add("stat_date", F.least(F.lit(days_each - 1) - F.col("day") % days_each, F.lit(days - 1) - F.col("day")).cast("int")), "yyyy-MM-dd").alias("until"),
            "cells",
        )
        one = packed(placed, key)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("sha256", F.sha2("content", 256))


def write(made_files: DataFrame, folder: str) -> DataFrame:
    """Put files into a folder that all executors reach (a path or URI), each by the task that has it: path, bytes and sha256 of what was written.

    A file is written under another name and moved, so that a task that runs again, or a reader that looks meanwhile,
    finds whole files only. Other columns of the files are returned with them.
    """
    more = [f for f in made_files.schema if f.name not in ("path", "content", "bytes", "sha256")]
    names = [f.name for f in more]

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for part in parts:
            done = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                raw, whole = bytes(raw), f"{base.rstrip('/')}/{path}"
                with store.open_output_stream(f"{whole}.part") as out:
                    out.write(raw)
                store.move(f"{whole}.part", whole)
                done.append((path, len(raw), hashlib.sha256(raw).hexdigest()))
            found = pd.DataFrame(done, columns=["path", "bytes", "sha256"])
            yield pd.concat([found, part[names].reset_index(drop=True)], axis=1)

    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()), *more])
    return made_files.select("path", "content", *names).mapInPandas(put, shape)
