"""Personal data: base patterns, and bootstrapped contextual extraction (after Riloff and Jones, 1999).

Native: DataFrame functions only. Every whole text is read once. The base spans of four kinds are the seed entities.
The one and two words before a seed induce lexical patterns; every identifier-shaped run that no base span covers is a
candidate instance of the patterns before it. Spark scores the graph of patterns and instances in rounds, until one
accepts nothing new:

- a pattern's confidence is the sum of its known instances' scores of its commonest kind, over that of all kinds and its
  contradicting instances, each whole, and those that nothing is known of, each ``doubt``;
- an instance is contradicted if one of its patterns has ``least_seeds`` instances or more, none that is known, and fewer
  than half that a pattern with ``least_seeds`` known ones has too;
- an unknown instance's score is the chance that not all its confident patterns err, halved if it is contradicted.

Instances over the bar are known in the next round, of their best pattern's kind, so that they induce patterns that no
seed has. In the end they become spans.

A pattern is a context for one form: runs with letters, or of digits and signs alone. A run that has the form of a card
or an ip and isn't one, by the base rules, is no candidate: it has been looked at.

The graph holds distinct (pattern, instance) pairs, aggregated before each shuffle, and its joins are plain, so that
Spark may split a frequent pattern. Scores are added as decimals: the result doesn't depend on the order of rows.

Positions come from the lengths of the pieces between matches, in code points, summed up in blocks. The patterns below
are written with possessive runs and a guard against starting inside a run; they match exactly as the plain forms in the
comments, in time linear in the text.

Nulls and odd rows: a null text is empty and has no spans. Repeated rows each get their spans, and count once as
instances. A match before another counts as the word ``#`` of its context. Of equal kinds of a pattern the first listed
wins. Documents without digits or ``@`` pass the first test only. Extra columns are kept by name. An empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import SPACES, Scratch, let, lower_ascii, whole

#: Kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
SPAN = "struct<start:bigint,kind:int,stop:bigint>"
#: Groups of digits with one or two separators between, none before a letter, else a run with a digit or @ in it up to its
#: last letter or digit. All runs are possessive and what is asked after them is one character: no part is tried twice.
CANDIDATE = r"(?<![A-Za-z0-9@_.+=-])(?:\+?\(?[0-9]++(?:[\x20./()-]{1,2}+[0-9]++(?![A-Za-z0-9@_=]))++|[A-Za-z_.+=-]*+(?:[0-9]|@[@_.+=-]*+[A-Za-z0-9])(?:[@_.+=-]*+[A-Za-z0-9])*+)"
BLOCK = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Digits from the right, every second doubled, sum divisible by ten."""
    back = F.transform(F.split(F.reverse(_digits(x)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    part = F.transform(F.filter(back, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(x)).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def running(values: Column, op, zero: Column) -> Column:
    """op over the values up to each place: within blocks, and over the blocks before."""
    fold = lambda x: F.aggregate(x, zero, op)
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda k: fold(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda b: F.transform(b, lambda _, k: fold(F.slice(b, F.lit(1), k))))
        return let(before, lambda b: F.transform(v, lambda _, i: op(F.get(b, block(i)), fold(F.slice(v, block(i) * BLOCK + 1, i % BLOCK + 1)))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def _placed(text: Column, pattern: str) -> Column:
    """All matches as structs (start, hit, left): code points before the match, the match, and the text since the one before."""
    def join(pieces: Column, hits: Column) -> Column:
        gaps = F.transform(hits, lambda h, i: (F.length(F.get(pieces, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(hits, i - 1)))).cast("bigint"))
        left = lambda i: F.concat(F.when(i == 0, "").otherwise("# "), F.get(pieces, i))
        return let(let(gaps, lambda g: running(g, lambda a, x: a + x, F.lit(0).cast("bigint"))), lambda s: F.transform(hits, lambda h, i: F.struct(F.get(s, i).alias("start"), h.alias("hit"), left(i).alias("left"))))

    return let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: join(p, h)))


def _contexts(left: Column) -> Column:
    """The last word, and the last two, before a place; words lower-cased, without those that have no letter but ``#``."""
    words = F.filter(F.split(F.btrim(lower_ascii(left), F.lit(SPACES)), r"[\x20\x09-\x0D]+"), lambda w: (w == "#") | w.rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"))
    return let(F.slice(F.concat(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")), words), -2, 2), lambda w: F.filter(F.array(F.when(w[1] != "#", w[1]), F.concat(w[0], F.lit(" "), w[1])), lambda x: x.isNotNull()))


def _outside(cand: Column, base: Column) -> Column:
    """The candidates that overlap no base span. Both by start: what ends last among those before, what begins first after."""
    none = F.lit(None).cast("bigint")
    at = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["stop"].alias("stop"), x["hit"].alias("hit"), x["ctx"].alias("ctx"))

    def free(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: F.when(x["own"] == 0, x["stop"]).otherwise(F.lit(-1).cast("bigint"))), lambda a, x: F.greatest(a, x), F.lit(-1).cast("bigint"))
        ahead = F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(none))), lambda a, x: F.coalesce(x, a), none))
        alone = lambda x, i, r, a: (x["own"] == 1) & (F.get(r, i) <= x["start"]) & F.coalesce(F.get(a, i) >= x["stop"], F.lit(True))
        found = let(reach, lambda r: let(ahead, lambda a: F.filter(m, lambda x, i: alone(x, i, r, a))))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["hit"].alias("hit"), x["ctx"].alias("ctx")))

    merged = F.sort_array(F.concat(F.transform(base, at(0)), F.transform(cand, at(1))))
    return F.when((F.size(base) == 0) | (F.size(cand) == 0), cand).otherwise(let(merged, free))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base`` (start, kind, stop, hit, ctx) and ``cand`` (start, stop, hit, ctx), both by start."""
    body = whole(F.col(text))
    none = F.array().cast("array<struct<start:bigint,hit:string,left:string>>")
    out = docs

    def seeds(n: int, kind: str) -> Column:
        found = F.when(body.rlike(NEEDS[kind]), F.filter(_placed(body, PATTERNS[kind]), lambda m: _valid(kind, m["hit"]))).otherwise(none)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), (m["start"] + F.length(m["hit"])).alias("stop"), m["hit"].alias("hit"), _contexts(m["left"]).alias("ctx")))

    out = out.withColumns({f"_{kind}": seeds(n, kind) for n, kind in enumerate(KINDS)})
    out = out.withColumn("base", F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS]))).drop(*[f"_{k}" for k in KINDS])

    def shaped(m: Column) -> Column:
        hit, digits, lettered = m["hit"], F.length(_digits(m["hit"])), m["hit"].rlike("[A-Za-z]")
        judged = ~lettered & (digits.between(14, 19) | hit.rlike(r"^[0-9]+(\.[0-9]+){3}$"))
        return (F.length(hit) >= 6) & ((digits >= 5) | F.contains(hit, F.lit("@")) | (lettered & (digits >= 2))) & ~judged

    tokens = F.when(body.rlike("[0-9@]"), F.filter(_placed(body, CANDIDATE), shaped)).otherwise(none)
    cand = F.transform(tokens, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["hit"])).alias("stop"), m["hit"].alias("hit"), _contexts(m["left"]).alias("ctx")))
    return out.withColumn("cand", let(cand, lambda c: _outside(c, F.col("base"))))


def bootstrap(found: DataFrame, scratch: Scratch, rounds: int | None = None, least_seeds: int = 4, bar: float = 0.8, doubt: float = 0.05) -> DataFrame:
    """found: a written table with base and cand. The accepted instances: hit, kind.

    Rounds go on until one finds nothing new, or for so many as given.
    """
    form = F.when(F.col("m.hit").rlike("[A-Za-z]"), "a ").otherwise("0 ")
    pairs = lambda name, kind: found.select(F.explode(name).alias("m")).select(F.explode("m.ctx").alias("c"), "m", form.alias("f")).select(F.concat("f", "c").alias("pattern"), "m.hit", kind.alias("kind"))
    edges = scratch.keep(pairs("base", F.col("m.kind")).union(pairs("cand", F.lit(None).cast("int"))).groupBy("pattern", "hit").agg(F.min("kind").alias("kind")))
    exact = lambda c: F.round(c, 9).cast("decimal(20,9)")
    seeds = edges.where("kind is not null").groupBy("hit").agg(F.min("kind").alias("as")).select("hit", "as", exact(F.lit(1.0)).alias("score"))
    known, fresh = seeds, edges.sparkSession.createDataFrame([], "hit string, as int, score decimal(20,9)")
    for _ in count() if rounds is None else range(rounds):
        of_kind = [F.coalesce(F.sum(F.when(F.coalesce("kind", "as") == k, F.col("score"))), F.lit(0)).alias(f"s{k}") for k in range(len(KINDS))]
        stats = scratch.keep(edges.join(known, "hit", "left").groupBy("pattern").agg(F.count("*").alias("n"), F.count("score").alias("n_known"), *of_kind))
        unknown = edges.join(known, "hit", "left_anti")
        warm = stats.where(F.col("n_known") >= least_seeds).withColumn("top", F.greatest(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("kind")) for k in range(len(KINDS))]))
        touched = unknown.join(warm.select("pattern"), "pattern", "left_semi").select("hit").distinct().withColumn("_yes", F.lit(1))
        blank = unknown.join(stats.where((F.col("n_known") == 0) & (F.col("n") >= least_seeds)).select("pattern"), "pattern", "left_semi")
        cold = blank.join(touched, "hit", "left").groupBy("pattern").agg(F.count("*").alias("n"), F.count("_yes").alias("yes")).where(2 * F.col("yes") < F.col("n")).select("pattern")
        against = scratch.keep(blank.join(cold, "pattern", "left_semi").select("hit").distinct().withColumn("_no", F.lit(1)))
        noes = unknown.join(against, "hit").join(warm.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.sum("_no").alias("no"))
        no, sure = F.coalesce("no", F.lit(0)), sum((F.col(f"s{k}") for k in range(1, len(KINDS))), F.col("s0"))
        conf = F.col("top.s") / (sure + no + F.lit(doubt) * (F.col("n") - F.col("n_known") - no) + 0.25)
        trusted = warm.join(noes, "pattern", "left").select("pattern", (-F.col("top.kind")).alias("as"), F.round(conf.cast("double"), 9).alias("conf")).where(F.col("conf") >= bar)
        err = F.exp(F.sum(exact(F.log(1.000001 - F.col("conf")))).cast("double"))
        said = unknown.join(trusted, "pattern").groupBy("hit").agg((1 - err).alias("score"), F.max_by("as", F.struct("conf", -F.col("as"))).alias("as"))
        new = said.join(against, "hit", "left").select("hit", "as", exact(F.col("score") / (1 + F.coalesce("_no", F.lit(0)))).alias("score")).where(F.col("score") >= bar)
        more = scratch.keep(new)
        if more.isEmpty():
            break
        fresh = fresh.unionByName(more)
        known = seeds.unionByName(fresh)
    return fresh.select("hit", F.col("as").alias("kind"))


def find(docs: DataFrame, scratch: Scratch, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns (all of docs by default) with base, added and spans: arrays of (start, kind, stop) by start and kind."""
    keep = docs.columns if keep is None else keep
    found = scratch.keep(with_candidates(docs.withColumn("_rid", F.monotonically_increasing_id()), text).select("_rid", *keep, "base", "cand"))
    new = bootstrap(found, scratch)
    spots = found.where(F.size("cand") > 0).select("_rid", F.explode("cand").alias("m")).join(new, F.col("m.hit") == F.col("hit"))
    added = scratch.keep(spots.groupBy("_rid").agg(F.collect_list(F.struct(F.col("m.start").alias("start"), "kind", F.col("m.stop").alias("stop"))).alias("added")))
    asked = found.where(F.size("cand") > 0).join(added, "_rid", "left").unionByName(found.where(F.size("cand") == 0), allowMissingColumns=True)
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    out = asked.select(*keep, base.alias("base"), F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))
    return out.withColumn("spans", F.sort_array(F.concat("base", "added")))


def is_kind(n: int):
    return lambda s: s["kind"] == n


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first names the whole.

    The text is cut into pages, so that a part is found without going over all that is before it.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    page = 4096
    none = F.lit(0).cast("bigint")

    def cut(s: Column, reach: Column, pages: Column) -> Column:
        """The text between the spans that begin a group, each after the reach of those before it, and the groups' names."""
        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / page).cast("int"), F.floor(b / page).cast("int")
            return F.substr(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), (a - first * page + 1).cast("int"), (b - a).cast("int"))

        before = lambda i: F.coalesce(F.get(reach, i - 1), none)
        heads = F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(part(before(i), x["start"]), F.get(names, x["kind"]))).otherwise(""))
        return F.concat(F.array_join(heads, ""), part(F.element_at(reach, -1), F.length(text).cast("bigint")))

    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / page).cast("int")), lambda k: F.substr(text, k * page + 1, F.lit(page)))
    ends = lambda s: running(F.transform(s, lambda x: x["stop"]), lambda a, x: F.greatest(a, x), none)
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda s: let(ends(s), lambda r: let(pages, lambda p: cut(s, r, p)))))
