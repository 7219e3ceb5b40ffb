"""A training corpus from documents: five stages, each written and read again as the next one's documents.

Quality rules reject documents, near-dedup keeps one of each group, personal data is replaced by its kind,
sources are mixed to their targets, and what is left is packed into sequences.
"""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import jaccard, mixture, packing, pii, quality, simhash
from tallyhouse.llm.common import Scratch, whole

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the outlier test reject go."""
    scratch = Scratch(spark)
    numbers = scratch.keep(quality.with_statistics(docs.select(*COLUMNS)))
    return quality.judge(numbers, scratch).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of its smallest doc_id.

    Texts are linked if their fingerprints of 5-word shingles differ in 2 bits or fewer, which the covering tables find
    whole, or if MinHash bands find them and their exact similarity on 5-word shingles is 0.8 or more.

    Rows that share this doc_id are told apart by the hash of their text, and whole copies among them by an aggregate
    over these rows alone. A component without any doc_id keeps the row with the smallest hash.
    """
    scratch = Scratch(spark)
    texted = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text", "lang", "source", "n_chars"))
    prints = scratch.keep(texted.select("doc_id", "_h", jaccard.node().alias("node")))
    nodes = texted.select(jaccard.node().alias("node"), "text")
    marks = scratch.keep(simhash.with_fingerprint(nodes, shingle=5).select("node", "fp"))
    lead = scratch.keep(marks.groupBy("fp").agg(F.min("node").alias("lead")))  # one node stands for all of a fingerprint
    same = marks.join(lead, "fp").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = simhash.links(lead.select("fp"), scratch).join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = scratch.keep(jaccard.groups(nodes, same.union(near), scratch))
    parts = prints.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h"))
    chosen = scratch.keep(parts.agg(first.alias("m")).select(F.col("m.doc_id").alias("doc_id"), F.col("m._h").alias("_h")))
    many = prints.join(chosen, prints.doc_id.eqNullSafe(chosen.doc_id) & (prints._h == chosen._h), "left_semi").groupBy("doc_id", "_h").agg(F.count("*").alias("n"))
    flagged = chosen.join(many, chosen.doc_id.eqNullSafe(many.doc_id) & (chosen._h == many._h)).select(chosen.doc_id.alias("_id"), chosen._h.alias("_k"), (F.col("n") > 1).alias("_many"))
    kept = texted.join(flagged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")))
    return kept.where("not _many").select(*COLUMNS).unionByName(kept.where("_many").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS))


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with a new text and its length, counted in a step of its own: beside an alias that hides the old text, its name inside a lambda means the new one."""
    return docs.withColumn("_text", text).select("doc_id", F.col("_text").alias("text"), "lang", "source", F.length("_text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found becomes its kind in angle brackets."""
    found = pii.find(docs.select(*COLUMNS), Scratch(spark))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(pii.redacted(whole(F.col("text")), F.col("spans")))
    return _with_text(found, text)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target amounts: a document taken more than once is repeated, the one at a cut shortened."""
    sized = docs.select(*COLUMNS).withColumns({"size": mixture.word_count(F.col("text")), "text_key": F.md5(whole(F.col("text")).cast("binary"))})
    scratch = Scratch(spark)
    narrow = sized.select("doc_id", "source", "size", "text_key")
    taken = scratch.keep(mixture.mix(narrow, scratch).where("taken > 0").groupBy("doc_id", "source", "text_key").agg(F.collect_list("taken").alias("all")))
    match = (F.col("doc_id").eqNullSafe(F.col("_id"))) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_key") == F.col("_key"))
    both = sized.join(taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_key"), "all"), match)
    mixed = both.where(F.size("all") == 1).unionByName(both.where(F.size("all") > 1).dropDuplicates(["doc_id", "source", "text_key"]))
    times = mixed.withColumn("_take", F.explode("all")).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.expr("cast((_take - 1) div size as int)"))))
    words = F.least(F.col("size"), F.col("_take") - F.col("_pass") * F.col("size"))
    text = F.when(words == F.col("size"), F.col("text")).otherwise(mixture.first_words(F.col("text"), words))
    return _with_text(times, text)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", whole(F.col("text")).alias("text")), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mixture", source_mixture), ("vector_packing", vector_packing)]

#: Tokenizer ids and fingerprints are beyond SQL; a test holds near_dedup against plain Python, the other stages by their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
