"""Which SKU a channel's product is: confirmed mapping, exact code, or likely names.

Codes are matched once each and joined back to the facts. Names are compared within blocks: of an unmapped product and
the SKUs, only pairs whose lengths allow the score and that share a character of the shorter name meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.columns import normal_name, similarity

HIGH, MEDIUM, LEAST_POOL = 90.0, 75.0, 5
RANGES = 1024


def match_codes(codes: DataFrame, mappings: DataFrame, skus: DataFrame) -> DataFrame:
    """codes: platform_key, platform_product_code. Adds sku_id and match_type: mapping, exact or unmapped."""
    known = mappings.where("sku_id is not null").select("platform_key", "platform_product_code", F.col("sku_id").alias("_mapped"))
    exact = skus.where("status = 'active'").select(F.col("sku_code").alias("platform_product_code"), F.col("id").alias("_exact"))
    both = codes.join(known, ["platform_key", "platform_product_code"], "left").join(exact, "platform_product_code", "left")
    kind = F.when(F.col("_mapped").isNotNull(), "mapping").when(F.col("_exact").isNotNull(), "exact").otherwise("unmapped")
    return both.select("platform_key", "platform_product_code", F.coalesce("_mapped", "_exact").alias("sku_id"), kind.alias("match_type"))


def attach(facts: DataFrame, mappings: DataFrame, skus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts with sku_id, and one row a code: the mapping rows to upsert (match_type, confidence) with product names."""
    key = ["platform_key", "platform_product_code"]
    named = facts.groupBy(*key).agg(F.min(F.when(F.col("product_name").isNotNull(), F.struct("row_no", "product_name")))["product_name"].alias("platform_product_name"))
    found = match_codes(named.select(*key), mappings, skus)
    out = facts.drop("sku_id").join(found.select(*key, "sku_id"), key, "left").select(*facts.columns)
    return out, named.join(found, key)


def match_counts(found: DataFrame, *by: str) -> DataFrame:
    """How many codes were matched in each way."""
    return found.groupBy(*by, "match_type").agg(F.count("*").alias("codes"))


def _letters(c):
    """The characters of a name with the number of the same ones before each."""
    return F.transform(F.split(c, ""), lambda x, i: F.concat(x, F.size(F.filter(F.slice(F.split(c, ""), F.lit(1), i), lambda y: y == x)).cast("string")))


def _rarest(names: DataFrame, name: str, marks: DataFrame, cutoff: float) -> DataFrame:
    """name, _ch: the characters of which a likely name must have one. A score of c over lengths a and b needs c/200 * (a + b)
    characters in common, and b is c/(200 - c) of a at least."""
    need = F.ceil(F.length(name) * (cutoff / (200.0 - cutoff)) - 1e-9)
    ranked = names.withColumn("_ch", F.explode(_letters(F.col(name)))).join(marks, "_ch").withColumn("_nth", F.row_number().over(Window.partitionBy(name).orderBy("_often", "_ch")))
    return ranked.where(F.col("_nth") <= F.length(name) - need + 1).select(name, "_ch")


def candidates(products: DataFrame, skus: DataFrame, k: int = 3, cutoff: float = MEDIUM) -> DataFrame:
    """products: key columns, product_name, category. The k likeliest active SKUs of each with score, band and rank.

    SKUs of the product's category are asked if there are at least five, else all. Equal scores go by SKU number.
    A score of ``cutoff`` needs a length ratio and so many characters in common that two names share one of the rarest of
    each (the prefix filter), so names meet by these.
    """
    keys = [c for c in products.columns if c not in ("product_name", "category")]
    target = products.withColumn("_t", normal_name(F.col("product_name"))).where("_t <> ''")
    pool = skus.where("status = 'active'").select(F.col("id").alias("sku_id"), "sku_code", F.col("name").alias("sku_name"), F.col("category").alias("_c"), normal_name(F.col("name")).alias("_s")).where("_s <> ''")
    sizes = skus.where("status = 'active'").groupBy(F.col("category").alias("_cat")).agg(F.count("*").alias("_n"))
    target = target.join(sizes, F.col("category") == F.col("_cat"), "left").withColumn("_own", F.coalesce(F.col("_n") >= LEAST_POOL, F.lit(False)) & (F.coalesce("category", F.lit("")) != "")).drop("_cat", "_n")
    # names are compared once each, and of SKUs with one name and category the first k can be asked for
    first = F.row_number().over(Window.partitionBy("_s", "_c").orderBy("sku_id"))
    pool = pool.withColumn("_nth", first).where(F.col("_nth") <= k).drop("_nth")
    left, right = target.select("_t").distinct(), pool.select("_s").distinct()
    marks = left.select(F.explode(_letters(F.col("_t"))).alias("_ch")).union(right.select(F.explode(_letters(F.col("_s"))))).groupBy("_ch").agg(F.count("*").alias("_often"))
    met = _rarest(left, "_t", marks, cutoff).join(_rarest(right, "_s", marks, cutoff), "_ch")
    bound = 200.0 * F.least(F.length("_t"), F.length("_s")) / (F.length("_t") + F.length("_s")) >= cutoff
    scored = met.where(bound).select("_t", "_s").distinct().withColumn("score", similarity(F.col("_t"), F.col("_s"))).where(F.col("score") >= cutoff)
    pairs = target.join(scored, "_t").join(pool, "_s").where(~F.col("_own") | (F.col("category") == F.col("_c")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "sku_id"))
    band = F.when(F.col("score") >= HIGH, "high").otherwise("medium")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "sku_id", "sku_code", "sku_name", "score", band.alias("band"), "rank")


def upserted(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """mappings with changes (platform_key, platform_product_code, platform_product_name, sku_id, match_type, confidence).

    A blank new name keeps the old one, and a NULL sku never clears a confirmed one.
    """
    key = ["platform_key", "platform_product_code"]
    new = changes.select(*key, *[F.col(c).alias("_" + c) for c in ("platform_product_name", "sku_id", "match_type", "confidence")], F.lit(True).alias("_new"))
    both = mappings.join(new, key, "full_outer")
    keep = F.col("_new").isNull() | (F.col("_sku_id").isNull() & F.col("sku_id").isNotNull())
    top = mappings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    # new rows are numbered within the ranges of a hash, and these go on from one another
    both = both.crossJoin(F.broadcast(top)).withColumn("_range", F.when(F.col("id").isNull(), F.pmod(F.xxhash64(*key), F.lit(RANGES))))
    sizes = both.where("_range is not null").groupBy("_range").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("_range").alias("_r"), (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_start"))  # RANGES rows at most
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*key))
    old, new_rows = both.where("_range is null"), both.where("_range is not null").withColumn("_nth", nth).join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    both = old.unionByName(new_rows.withColumn("id", F.col("_top") + F.col("_start") + F.col("_nth")).select(*old.columns))
    name = F.when(F.coalesce("_platform_product_name", F.lit("")) == "", F.col("platform_product_name")).otherwise(F.col("_platform_product_name"))
    pick = lambda c: F.when(keep, F.col(c)).otherwise(F.col("_" + c)).alias(c)
    return both.select("id", *key, name.alias("platform_product_name"), *[pick(c) for c in ("sku_id", "match_type", "confidence")])


def backfilled(facts: DataFrame, changes: DataFrame, only_old: bool = False) -> DataFrame:
    """All rows of the uploads that hold a changed product, with its new SKU: what must be written anew, and no more.

    changes: platform_key, platform_product_code and _new, one row a product; with only_old also _old, and only rows
    that have this SKU change. The uploads are found by a narrow scan, and meet the facts by upload, so that partitions
    of other uploads need not be read.
    """
    key = ["platform_key", "platform_product_code"]
    change = changes.select(*key, F.struct("_new", *["_old"] * only_old).alias("_change"))
    hit = F.col("_change").isNotNull() & (F.col("sku_id").eqNullSafe(F.col("_change._old")) if only_old else F.lit(True))
    touched = facts.select("upload_id", "sku_id", *key).join(change, key).where(hit).select("upload_id").distinct()
    own = facts.join(touched, "upload_id", "left_semi").join(change, key, "left")
    return own.withColumn("sku_id", F.when(hit, F.col("_change._new")).otherwise(F.col("sku_id"))).select(*facts.columns)
