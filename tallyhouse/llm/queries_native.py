"""The queries of the native operators: personal data, url filters and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import pii, quality, urls
from tallyhouse.llm.common import Scratch, table

#: The rules of the url query.
URL_RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, Scratch(spark), keep=["doc_id"])
    counts = [F.size(F.filter("base", pii.is_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES, Scratch(spark))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    numbers = scratch.keep(quality.with_statistics(docs).drop("text"))
    return quality.judge(numbers, scratch).select("doc_id", *quality.STATS, "base_failed", "kept")
