"""The queries of the other operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import license, middle, mixture, nearest, packing, repeats, sharding, simhash, toxicity, weighted
from tallyhouse.llm.common import SPACE_RUN, SPACES, Scratch, table, whole

SHARDS = 40


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark), lambda i: F.pmod(i, F.lit(20)) == 0)


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(sharding.sized(table(spark, sf_dir, "documents")), SHARDS, Scratch(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scratch = Scratch(spark)
    model = toxicity.train(docs.where(~held_out).join(labels, "doc_id").select("doc_id", "text", "label"), scratch)
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixture.word_count(F.col("text")).alias("size"), F.lit("").alias("text_key"))
    return mixture.mix(docs, Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan(docs, Scratch(spark)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    prints = scratch.keep(simhash.with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    return simhash.near_duplicates(prints, scratch).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole(F.col("text")).alias("text"))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compared(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(middle.restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def repeating(docs: DataFrame) -> DataFrame:
    """docs whose texts, for a tenth of the doc_ids, repeat a piece of theirs from some word on to the end. A null doc_id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim(whole(F.col("text")), F.lit(SPACES))
    g = F.floor(h / 10)
    w = F.split(bare, SPACE_RUN)
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0) & (bare != "")
    return docs.withColumn("text", F.when(chosen, F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.with_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = found.withColumn("_best", longest)
    length = -F.col("_best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * -_best.less) div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
