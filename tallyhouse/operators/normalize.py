"""From rows of text cells to typed sales facts and row errors, by a channel's specification.

The specification becomes Column expressions: one projection casts every field, gathers its errors and tries the filters;
the merge of repeated rows and the final checks follow as DataFrame steps. Facts and errors are two results of one plan.
``keep`` may write the cast rows and read them back, so that the cells are parsed once for all results. Casts are steps of
plain columns, without lambdas, which Spark would interpret row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import formula
from tallyhouse.functions.columns import blank_to_null, clean_text, day, day_value, delete_chars, filled, is_number, money, money_value, to_number, ustrip, whole_number, whole_value
from tallyhouse.schema import FACTS, MONEY_FIELDS, NUMERIC_FIELDS
from tallyhouse.session import small_methods
from tallyhouse.sources.spec import Spec

ERROR = "array<struct<error_type:string,error_message:string>>"
MOST_CONTENT = 2000
#: What numeric fields without a transform may hold beside the number.
LOOSE = r"(?U)[,，￥¥元\s]"


@dataclass
class Normalised:
    facts: DataFrame
    errors: DataFrame
    total: DataFrame
    merged: DataFrame

    def counts(self) -> DataFrame:
        """One row by one job: total, valid, filtered, duplicated, failed; failed counts errors, not rows.

        total has the cast rows and merged a row a key with _why, its error: no text and no join is needed to count.
        """
        of = lambda name: F.coalesce(F.sum(F.size(F.filter("_errors", lambda e: e["error_type"].isin(*KINDS[name])))), F.lit(0)).alias(name)
        rows = self.total.agg(F.count("*").alias("total"), F.count_if(F.size("_errors") == 0).alias("_good"), of("filtered"), of("failed"))
        kept = self.merged.agg(F.count("*").alias("_kept"), F.count("_why").alias("_invalid"))
        n = F.col
        return rows.crossJoin(kept).select("total", (n("_kept") - n("_invalid")).alias("valid"), "filtered", (n("_good") - n("_kept")).alias("duplicated"), (n("failed") + n("_invalid")).alias("failed"))

    def stats(self) -> dict[str, int]:
        return self.counts().first().asDict()


#: What errors are counted as.
KINDS = {"filtered": ["filtered_out"], "duplicated": ["duplicate_row"], "failed": ["number_parse_failed", "date_parse_failed"]}


def cast_counts() -> dict[str, Column]:
    """Aggregates over the rows of typed(), for their write to observe."""
    return {"good": F.count_if(F.size("_errors") == 0), "cell_errors": F.coalesce(F.sum(F.size("_errors")), F.lit(0))}


def error_counts() -> dict[str, Column]:
    """The same over errors."""
    return {name: F.count_if(F.col("error_type").isin(*kinds)) for name, kinds in KINDS.items()}


def observed_stats(cast: dict, errors: dict) -> dict[str, int]:
    """Normalised.stats() from what the writes of cast rows and of errors observed. Rows without an error of their own are facts but for those that a later error names."""
    return {"total": cast["rows"], "valid": cast["good"] - (errors["rows"] - cast["cell_errors"]), **{k: errors[k] for k in KINDS}}


def cast_field(text: Column, rule: dict | None) -> tuple[Column, str | None]:
    """struct(value, failed) of a cell under a transform, and the error it makes."""
    if rule is None or rule["type"] == "string":
        return F.struct(clean_text(text, (rule or {}).get("strip_chars")).alias("value"), F.lit(False).alias("failed")), None
    bare = delete_chars(text, rule.get("strip_chars"))
    if rule["type"] == "money":
        return money(bare, rule.get("unit") or "yuan", rule.get("default")), "number_parse_failed"
    if rule["type"] == "integer":
        return whole_number(bare, rule.get("default")), "number_parse_failed"
    return day(bare, rule["formats"]), "date_parse_failed"


def loose_number(text: Column, kind: str) -> Column:
    """struct(value, failed) for numeric fields without a transform."""
    bare = F.regexp_replace(text, LOOSE, "")
    return money(bare) if kind == "money" else whole_number(bare)


def passes(c: Column, f: dict) -> Column:
    """Whether a value passes one filter; the 13 operators' rules for NULL."""
    op, text = f["op"], c.cast("string")
    if op == "not_null":
        return c.isNotNull() & (ustrip(text) != "")
    if op == "is_null":
        return c.isNull() | (ustrip(text) == "")
    if op == "numeric":
        return is_number(text)
    if op in ("in", "not_in"):
        found = F.coalesce(text.isin(*map(str, f["values"])), F.lit(False))
        return found if op == "in" else ~found
    if op in ("contains", "not_contains"):
        found = F.coalesce(F.lit(False), F.lit(False))
        for v in f["values"]:
            found = found | F.coalesce(F.contains(text, F.lit(str(v))), F.lit(False))
        return found if op == "contains" else ~found
    try:
        left, right = to_number(text), F.lit(float(f["value"]))
    except ValueError:
        left, right = text, F.lit(str(f["value"]))
    test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right, "eq": left == right, "neq": left != right}[op]
    return F.coalesce(test, F.lit(op == "neq"))


def merge_rows(rows: DataFrame, spec: Spec, null_as_zero: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key of the specification: keys, row_no, ``raw`` of that row, and for ``sum`` numeric fields added and the first text that isn't blank.

    With null_as_zero a NULL sum is 0 for a field that has any value among the rows. ``first`` and ``last`` keep a row's
    own fields. Keys may be NULL. Columns of ``by`` tell files apart, and each file is merged by itself. Aggregates combine within tasks before the shuffle, so that a frequent key is no trap.
    """
    d = spec.dedup
    keys = [k for k in d["keys"] if k in rows.columns]
    if not d["enabled"] or not keys:
        return rows
    keys = [*by, *keys]
    fields = [c for c in rows.columns if c not in (*keys, "row_no", "raw")]
    pick = F.max_by if d["strategy"] == "last" else F.min_by
    # a column of its own, so that it is left out where nobody asks for it
    raw = [pick("raw", "row_no").alias("raw")] if "raw" in rows.columns else []
    if d["strategy"] != "sum":
        return rows.groupBy(*keys).agg(pick(F.struct("row_no", *fields), "row_no").alias("r"), *raw).select(*keys, "r.*", *[c for c in ("raw",) if raw])
    numeric = [c for c in fields if c in NUMERIC_FIELDS]
    first = [F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct("row_no", F.col(c).alias("v"))))["v"].alias(c) for c in fields if c not in numeric]
    merged = rows.groupBy(*keys).agg(F.min("row_no").alias("row_no"), *first, *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in numeric], *raw)
    if not (null_as_zero and numeric):
        return merged
    seen = rows.groupBy(*by).agg(*[F.max(F.col(c).isNotNull()).alias(f"_{c}") for c in numeric])  # a row a file
    zero = {c: F.coalesce(F.col(c), F.when(F.col(f"_{c}"), F.lit(0).cast(rows.schema[c].dataType))) for c in numeric}
    both = merged.join(seen, list(by)) if by else merged.crossJoin(F.broadcast(seen))
    return both.withColumns(zero).select(*merged.columns)


def steps(text: Column, rule: dict | None, kind: str | None) -> tuple[Column, Callable[[Column], Column], str | None]:
    """A cell's bare text, what makes the value of that once placeholders are filled, and the error of a filled text without value; cast_field() in steps.

    kind: of a numeric field without a transform, money or count.
    """
    if rule is None and kind:
        return F.regexp_replace(text, LOOSE, ""), money_value if kind == "money" else whole_value, "number_parse_failed"
    if rule is None or rule["type"] == "string":
        return delete_chars(text, (rule or {}).get("strip_chars")), blank_to_null, None
    bare = delete_chars(text, rule.get("strip_chars"))
    if rule["type"] == "money":
        return bare, lambda t: money_value(t, rule.get("unit") or "yuan"), "number_parse_failed"
    if rule["type"] == "integer":
        return bare, whole_value, "number_parse_failed"
    return ustrip(bare), lambda t: day_value(t, rule["formats"]), "date_parse_failed"


def typed(raw: DataFrame, header: list[str], spec: Spec, by: tuple[str, ...] = ()) -> DataFrame:
    """raw (by, row_no, cells) -> by, row_no, raw, the cast fields, shop_code, platform_key and the row's errors.

    Every cell is cast once: columns that several others use are steps of their own, and a generator stands before what
    tests the errors, since a filter on them would otherwise move below and cast again. Fields that nobody reads are
    not made.
    """
    small_methods(raw.sparkSession)
    source = spec.resolve(header)
    place = {h: i for i, h in enumerate(header)}
    cell = lambda h: F.coalesce(F.get("cells", F.lit(place[h])), F.lit(""))
    snapshot = F.to_json(F.map_from_arrays(F.array(*[F.lit(h) for h in header]), F.slice("cells", 1, len(header))))
    made = {u: steps(cell(h), spec.transforms.get(u), ("money" if u in MONEY_FIELDS else "count") if u in NUMERIC_FIELDS else None) for u, h in source.items()}
    bare = raw.select(*by, "row_no", "cells", *[text.alias(f"_t_{u}") for u, (text, _, _) in made.items()])
    default = {u: (spec.transforms.get(u) or {}).get("default") for u in made if (spec.transforms.get(u) or {}).get("type") in ("money", "integer")}
    ready = bare.select(*by, "row_no", "cells", *[(filled(F.col(f"_t_{u}"), default.get(u)) if kind else F.col(f"_t_{u}")).alias(f"_t_{u}") for u, (_, _, kind) in made.items()])
    cast = ready.select(*by, "row_no", "cells", *[(F.col(f"_t_{u}").isNotNull() if kind else F.lit(False)).alias(f"_t_{u}") for u, (_, _, kind) in made.items()], *[value(F.col(f"_t_{u}")).alias(f"_{u}") for u, (_, value, _) in made.items()])
    own = {u: F.col(f"_{u}") for u in made}
    failed = {u: F.col(f"_t_{u}") & own[u].isNull() for u, (_, _, kind) in made.items() if kind}
    errors = [F.when(failed[u], F.struct(F.lit(kind).alias("error_type"), F.concat(F.lit(f"字段 {u} 无法解析："), cell(source[u])).alias("error_message"))) for u, (_, _, kind) in made.items() if kind]
    own["shop_code"] = F.coalesce(*[blank_to_null(own[c]) for c in ("shop_code", "shop_name") if c in made], F.lit("__UNKNOWN__"))
    own["platform_key"] = F.lit(spec.platform_key)

    def target(c: str) -> Column:
        return own[c] if c in own else cell(c) if c in place else F.lit(None).cast("string")

    def kept(f: dict) -> Column:
        """passes(), where a value that was cast need not be read again."""
        kind = made[f["column"]][2] if f["column"] in made else None
        if kind and (f["op"] == "not_null" or f["op"] == "numeric" and kind == "number_parse_failed"):
            return own[f["column"]].isNotNull()
        return passes(target(f["column"]), f)

    why = F.lit(None).cast("string")
    for f in reversed(spec.row_filters):
        why = F.when(~kept(f), F.lit(f"被过滤：{f['column']} {f['op']}")).otherwise(why)
    # most rows have no error, and gathering them costs more than looking for one
    bad = F.when(reduce(or_, failed.values()), F.array_compact(F.array(*errors))).otherwise(F.array().cast(ERROR)) if errors else F.array().cast(ERROR)
    judged = cast.select(*by, "row_no", snapshot.alias("raw"), *[v.alias(u) for u, v in own.items()], bad.alias("_bad"), why.alias("_out"))
    out = F.when(F.col("_out").isNotNull(), F.array(F.struct(F.lit("filtered_out").alias("error_type"), F.col("_out").alias("error_message")))).otherwise(F.array().cast(ERROR))
    once = F.inline(F.array(F.struct(F.when(F.size("_bad") > 0, F.col("_bad")).otherwise(out).alias("_errors"))))
    return judged.select("*", once).drop("_bad", "_out")


def normalise(raw: DataFrame, header: list[str], spec: Spec, upload_id: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None) -> Normalised:
    """raw: row_no and cells of one file."""
    return finished((keep or (lambda df: df))(typed(raw, header, spec)), spec, upload_id)


def finished(rows: DataFrame, spec: Spec, upload_id: int = 0) -> Normalised:
    """Rows of typed(), of one file or, with upload_id among their columns, of many, each judged by itself."""
    by = ("upload_id",) if "upload_id" in rows.columns else ()
    good = rows.where(F.size("_errors") == 0).drop("_errors")
    full = merge_rows(good, spec, by=by)
    message = "重复行，已按 sum 策略合并（keys=%s）" % [k for k in spec.dedup["keys"] if k in good.columns] if spec.dedup["strategy"] == "sum" else f"重复行，按策略 {spec.dedup['strategy']} 保留另一条"
    for f in FACTS:
        if f.name not in full.columns and f.name not in ("upload_id", "raw_row_json", "net_amount"):
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    computed = full.withColumn("net_amount", F.bround(formula.compiled(spec.metric_semantics["net_amount_formula"]), 2).try_cast("decimal(14,2)"))
    error = lambda kind, text: F.struct(F.lit(kind).alias("error_type"), F.lit(text).alias("error_message"))
    why = F.when(F.col("gmv").isNull(), error("number_parse_failed", "必需列 gmv 缺失或无法解析，整行判为无效")).when(F.col("stat_date").isNull(), error("date_parse_failed", "必需列 stat_date 缺失或无法解析，整行判为无效"))
    checked = computed.withColumn("_why", why.when(F.col("net_amount").isNull(), error("number_parse_failed", "net_amount 计算失败")))
    facts = checked.where("_why is null").withColumns({"upload_id": F.col("upload_id") if by else F.lit(upload_id), "raw_row_json": F.col("raw"), "platform_product_code": F.coalesce("platform_product_code", F.lit(""))})
    facts = facts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACTS])
    # the texts of rows without a fact meet the merged rows by number
    met = rows.select(*by, "row_no", "raw", "_errors").join(checked.select(*by, "row_no", "_why", F.lit(True).alias("_kept")), [*by, "row_no"], "left")
    named = F.when(F.size("_errors") > 0, F.col("_errors")).when(F.col("_kept").isNull(), F.array(error("duplicate_row", message))).otherwise(F.array_compact(F.array("_why")))
    bad = met.select(*by, "row_no", "raw", F.explode(named).alias("e")).select(*by, "row_no", "e.*", "raw")
    content = F.when(F.length("raw") <= MOST_CONTENT, F.col("raw")).otherwise(F.concat(F.left("raw", F.lit(MOST_CONTENT)), F.lit("…")))
    return Normalised(facts, bad.select((F.col("upload_id") if by else F.lit(upload_id)).cast("long").alias("upload_id"), F.col("row_no").alias("row_number"), "error_type", "error_message", content.alias("raw_content")), rows, checked)
