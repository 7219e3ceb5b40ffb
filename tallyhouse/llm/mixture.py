"""Mixing sources to target weights.

Every document gets a hash-random key. The keys of a source are cut into even ranges by their first bits, so many that a
range has about ``per_range`` rows at most whatever the table's size, rows are sorted within each range, and prefix sums of word counts are made in two levels: within a range, and over the ranges
of a source. Each source is cut at its exact budget: a source whose target is over its size is gone through again, and
the document at the cut gives its first words only.

A source's range holds 1/ranges of it whatever its share of the rows, so that no task gathers a hot source. Targets are
filled by levels: sources whose cap is reached are fixed and the rest is shared anew, in rounds of one aggregate each.

Nulls and odd rows: a null text has no words. A null source is a source of its own, the last in order. Rows that agree
in doc_id go by size and then text. A source without words has target 0. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import SPACE_RUN, Scratch, whole
from tallyhouse.llm.numbering import with_row_number

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the order of sources, repeating.
WEIGHTS = [3, 1, 2]


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, scratch: Scratch, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds weight and target.

    The number of sources is not bounded, so they are ordered and filled as a table. A round fixes at least one more
    source at its cap or ends.
    """
    ordered = with_row_number(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("row_no", F.lit(len(WEIGHTS))) + 1).cast("int"))
    now = scratch.keep(ordered.select("source", "source_size", weight.alias("weight")))
    level, fixed = 0.0, -1
    total = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * cap
    while True:
        capped = F.col("weight") * level >= limit
        n, used, rest = now.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == fixed or not rest:
            break
        level, fixed = (total - (used or 0.0)) / rest, n
    return now.withColumn("target", F.least(limit, F.col("weight") * level))


def mix(docs: DataFrame, scratch: Scratch, seed: int = 11, per_range: int = 1 << 16, **shares: float) -> DataFrame:
    """docs: doc_id, source, size and the tie-breaker text_key. Adds source_size, target and taken.

    taken counts the words of all passes: with budget b and size s of a source, pass e takes what of words e*s to b
    falls on the document.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = scratch.keep(docs.withColumn("_key", key))
    bits = min(40, max(10, (keyed.count() // per_range).bit_length()))
    keyed = keyed.withColumn("_range", F.shiftright(F.conv(F.substring("_key", 1, 10), 16, 10).cast("long"), 40 - bits))
    in_range = keyed.groupBy("source", "_range").agg(F.sum("size").alias("n"))
    ranges = scratch.keep(in_range.withColumn("_start", F.sum("n").over(Window.partitionBy("source").orderBy("_range")) - F.col("n")))
    goals = scratch.keep(targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), scratch, **shares).select(F.col("source").alias("_source"), "source_size", "target"))
    starts = scratch.keep(ranges.join(goals, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("_range").alias("_r"), "_start", "source_size", "target"))
    within = F.sum("size").over(Window.partitionBy("source", "_range").orderBy("_key", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = keyed.withColumn("_before", within).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    budget = F.floor(F.col("target") + 0.5)
    whole_passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    at = F.col("_start") + F.col("_before")
    rest = budget - whole_passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - at))
    return placed.withColumn("taken", (whole_passes * F.col("size") + last).cast("long")).select(*docs.columns, "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    body = whole(text)
    return F.when(n <= 0, "").otherwise(F.regexp_extract(F.array_join(F.slice(F.split(F.regexp_replace(body, r"([\x20\x09-\x0D]+)", "$1\u0000"), "\u0000"), 1, (n + F.when(body.rlike("^" + SPACE_RUN), 1).otherwise(0)).cast("int")), ""), r"(?s)^(.*?)[\x20\x09-\x0D]*$", 1))
