"""Quality rules: word statistics of whole texts, and robust multivariate outliers among them.

Native: DataFrame functions only. The text is read once, for one row of numbers a document; everything after that
works on the numbers. Minimum-covariance-determinant estimates are made for each language and source: start from
quartiles, then concentration steps, each keeping the nearest three quarters of a group by Mahalanobis distance and
taking their mean and covariance anew. Quantiles come from counts in fixed bins, and moments from sums, so that a
group of any size is pre-aggregated in every task and reruns agree.

Nulls and odd rows: a null text is empty, and is rejected by the base rules. Null lang or source form a group of
their own. Groups under ``least_rows`` are pooled by language, those still under it over all languages; a pool under
it rejects nobody. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import SPACE_RUN, SPACES, Scratch, let, whole

#: The symbols counted.
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The smallest standard deviation allowed for each coordinate of the vector, so that a constant one is no trap.
FLOORS = [0.06, 0.05, 0.06, 0.05]
DIM = len(FLOORS)
#: The share of a group that its estimates are made of, and the quantile of chi-square with DIM degrees of freedom for it:
#: 1 - exp(-x/2) (1 + x/2) = KEPT.
KEPT, NEAREST = 0.75, 5.38527
#: What is kept has a smaller covariance than all of a normal group, by the share that chi-square with DIM + 2 degrees of
#: freedom has under NEAREST, over KEPT; this factor undoes it (Croux and Haesbroeck, 1999).
CONSISTENCY = KEPT / (1 - math.exp(-NEAREST / 2) * (1 + NEAREST / 2 + (NEAREST / 2) ** 2 / 2))
#: The 0.9999 quantile of the chi-square distribution with DIM degrees of freedom: exp(-x/2) (1 + x/2) = 0.0001.
CUTOFF = 23.5127


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more, the first included."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))

    def repeated(g: Column) -> Column:
        return F.sort_array(F.filter(F.transform(g, lambda e, i: F.when((e["h"] == F.get(g, i - 1)["h"]) | (e["h"] == F.get(g, i + 1)["h"]), e["i"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        found = let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda g: let(repeated(g), covered))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(found)

    return F.when(n < 6, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of STATS, n_lines and base_failed."""
    body = whole(F.col(text))
    bare = F.btrim(body, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    first = docs.withColumns({
        "_w": counts,
        "_l": dup,
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    })
    out = first.withColumns({"n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("_w", "_l").withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """Four transformed statistics; short texts are drawn to ordinary values, so that few words are no proof."""
    n = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 275) / (n + 50)),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 100)),
        F.col("n_dup_lines") / (F.col("n_lines") + 8),
        F.col("n_repeat_words") / (n + 50),
    ]


def _quantile_bin(counts: DataFrame, by: list[str], share: float, name: str) -> DataFrame:
    """The smallest bin up to which a group has at least this share of its rows. counts: by, bin, n."""
    w = Window.partitionBy(*by)
    run = counts.withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
    return run.where(F.col("_upto") >= share * F.col("_all")).groupBy(*by).agg(F.min("bin").alias(name))


def _factor(df: DataFrame) -> DataFrame:
    """Cholesky factor l_ij of the covariance c_ij (lower triangle), column by column."""
    for j in range(DIM):
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, DIM)})
    return df.select("grp", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of x0.. from m0.. under l_ij; null where the group has no estimate."""
    for i in range(DIM):
        df = df.withColumn(f"_y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"_y{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"_y{i}") ** 2 for i in range(DIM)), F.lit(0.0)))


def estimates(points: DataFrame, scratch: Scratch, steps: int = 3) -> DataFrame:
    """points (grp, x0..): one row of mean and Cholesky factor a group."""
    grid = 1024
    flat = points.select("grp", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * grid) for i in range(DIM)])).alias("k", "bin"))
    counts = scratch.keep(flat.groupBy("grp", "k", "bin").agg(F.count("*").alias("n")))
    q = _quantile_bin(counts, ["grp", "k"], 0.25, "a").join(_quantile_bin(counts, ["grp", "k"], 0.5, "b"), ["grp", "k"]).join(_quantile_bin(counts, ["grp", "k"], 0.75, "c"), ["grp", "k"])
    at = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name)))
    start = q.groupBy("grp").agg(*[((at("b", k) + 0.5) / grid).alias(f"m{k}") for k in range(DIM)], *[(((at("c", k) - at("a", k)) / grid / 1.349) ** 2 + FLOORS[k] ** 2).alias(f"c{k}{k}") for k in range(DIM)])
    now = scratch.keep(_factor(start.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(DIM) for j in range(i)})))
    for _ in range(steps):
        near = _distance(points.join(now, "grp")).withColumn("bin", F.floor(F.least(F.log2(1 + F.col("d2")), F.lit(60)) * 32).cast("int"))
        edge = scratch.keep(_quantile_bin(near.groupBy("grp", "bin").agg(F.count("*").alias("n")), ["grp"], KEPT, "upto"))
        core = near.join(edge, "grp").where("bin <= upto")
        # moments about the last centre lose no digits
        dev = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]
        sums = core.groupBy("grp").agg(F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"o{i}") for i in range(DIM)], *[F.sum(F.round(dev[i], 12).cast("decimal(30,12)")).cast("double").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.round(dev[i] * dev[j], 12).cast("decimal(30,12)")).cast("double").alias(f"s{i}{j}") for i in range(DIM) for j in range(i + 1)])
        mean = lambda i: F.col(f"s{i}") / F.col("n")
        moved = sums.select("grp", *[(F.col(f"o{i}") + mean(i)).alias(f"m{i}") for i in range(DIM)], *[(CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - mean(i) * mean(j)) + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)])
        now = scratch.keep(_factor(moved))
    return now


def judge(docs: DataFrame, scratch: Scratch, lang: str = "lang", source: str = "source", least_rows: int = 100, cutoff: float = CUTOFF) -> DataFrame:
    """docs that have STATS, n_lines and base_failed, as a written table: the same rows with d2 and kept."""
    key = lambda c, n: F.coalesce(F.concat(F.lit(n + "="), F.col(c)), F.lit(n))
    keyed = docs.withColumns({"_lang": key(lang, "l"), "_pair": F.concat_ws("\x1f", key(lang, "l"), key(source, "s"))}).withColumns({f"x{i}": x for i, x in enumerate(_vector())})
    good = keyed.where(~F.col("base_failed"))
    pairs = good.groupBy("_lang", "_pair").agg(F.count("*").alias("n"))
    small = F.col("n") < least_rows
    per_lang = Window.partitionBy("_lang")
    pooled = F.sum(F.when(small, F.col("n")).otherwise(0)).over(per_lang)
    level = F.when(~small, F.col("_pair")).when(pooled >= least_rows, F.concat(F.lit("pool "), F.col("_lang"))).otherwise(F.lit("pool"))
    groups = scratch.keep(pairs.withColumn("grp", level).select("_pair", "grp", "n"))
    points = good.join(groups, "_pair").select("grp", *[f"x{i}" for i in range(DIM)])
    enough = groups.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows).select("grp")
    fitted = groups.select("_pair", "grp").join(estimates(points.join(enough, "grp"), scratch), "grp").drop("grp")
    out = _distance(keyed.join(fitted, "_pair", "left"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).select(*docs.columns, "d2", "kept")
