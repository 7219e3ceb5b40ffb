"""Small Column functions with the engine's NULL and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as empty, and words of a product name that don't tell products apart.
PLACEHOLDERS = ["", "-", "--"]
SPEC_WORDS = ["克", "kg", "ml", "毫升", "片", "支", "盒", "袋", "装", "正品", "旗舰", "包邮", "新款"]


#: The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: Amounts as most cells have them, and days at full width, which Spark's casts read much faster than a format does.
AMOUNT = r"^-?[0-9]{1,12}(\.[0-9]{1,2})?$"
FULL_DAY = r"^[1-9][0-9]{3}(-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?|/[0-9]{2}/[0-9]{2})$"
MOST_DIGITS = 15
FULL_FORMATS = {"%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d"}


def ustrip(c: Column) -> Column:
    """Without Unicode white space at either end. Text of ASCII alone is held against fewer characters."""
    return F.when(F.octet_length(c) > F.length(c), F.btrim(c, F.lit(WHITE))).otherwise(F.btrim(c, F.lit(WHITE[: WHITE.index(" ") + 1])))


def blank_to_null(c: Column) -> Column:
    return F.nullif(ustrip(c), F.lit(""))


def composite_key(*names: str) -> Column:
    """The values of a group's columns joined by ``_``; a null reads ``None``."""
    return F.concat_ws("_", *[F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names])


def divide(a: Column, b: Column) -> Column:
    """a / b as DOUBLE; NULL if either is NULL or b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(now: Column, base: Column) -> Column:
    return F.round(divide(now.cast("double") - base.cast("double"), base), 4)


def pp_change(now: Column, base: Column) -> Column:
    return F.round((now - base) * 100, 4)


def delete_chars(c: Column, chars: list[str] | None) -> Column:
    """Literal removal, one entry after another, those of several characters first. A search for bytes that aren't there is cheap, where translate looks each character up."""
    for s in sorted((x for x in chars or [] if x), key=lambda x: len(x) == 1):
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def is_placeholder(c: Column) -> Column:
    return c.isNull() | c.isin(*PLACEHOLDERS)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_number(c: Column) -> Column:
    """DOUBLE if the text reads as a finite decimal number, else NULL.

    The cast takes such text and some more: names of infinities and NaN, which the bound leaves out, and forms with one
    of the letters d, f, x and p. Only text beyond ASCII can have white space that the cast doesn't know.
    """
    return let(_double(c), lambda d: F.when(F.abs(d) < float("1e26"), d))


def is_number(c: Column) -> Column:
    """Whether to_number() gives a number."""
    return F.coalesce(F.abs(_double(c)) < float("1e26"), F.lit(False))


def _double(c: Column) -> Column:
    bare = F.when(F.octet_length(c) > F.length(c), ustrip(c)).otherwise(c)
    return F.when(~c.rlike("[dDfFxXpP]"), bare.try_cast("double"))


def filled(text: Column, default: str | None = None) -> Column:
    """A cell's text, with the default in place of a placeholder."""
    return F.when(is_placeholder(text), F.lit(None if default in (None, "null") else default)).otherwise(text)


def money_value(text: Column, unit: str = "yuan") -> Column:
    """Two decimals, half to even, after a double and its shortest decimal; NULL if the text is no such number.

    A plain amount of at most 14 digits is its own shortest decimal and needs no double.
    """
    exact = _double(text).try_cast("decimal(38,10)")
    if unit == "fen":
        return F.bround(exact / 100, 2).try_cast("decimal(14,2)")
    return F.when(text.rlike(AMOUNT), text.try_cast("decimal(14,2)")).otherwise(F.bround(exact, 2).try_cast("decimal(14,2)"))


def whole_value(text: Column) -> Column:
    """Half away from zero. Whole numbers of at most 15 characters, which a double holds, are read as they are."""
    return F.coalesce(F.when(F.length(text) <= MOST_DIGITS, text.try_cast("long")), F.round(_double(text).try_cast("decimal(38,10)"), 0).try_cast("long"))


def _checked(text: Column, convert) -> Column:
    """struct(value, failed): what convert makes of the text; NULL of a text has failed."""
    return let(text, lambda t: let(convert(t), lambda v: F.struct(v.alias("value"), (t.isNotNull() & v.isNull()).alias("failed"))))


def money(text: Column, unit: str = "yuan", default: str | None = None) -> Column:
    """struct(value, failed) of money_value()."""
    return _checked(filled(text, default), lambda t: money_value(t, unit))


def whole_number(text: Column, default: str | None = None) -> Column:
    """struct(value, failed) of whole_value()."""
    return _checked(filled(text, default), whole_value)


#: Python date directives and what they are to Spark.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy"}


def spark_format(python_format: str) -> str:
    """A strptime format for Spark; months and days may lack a leading zero where something separates them."""
    if python_format == "%Y%m%d":
        return "yyyyMMdd"
    for a, b in DIRECTIVES.items():
        python_format = python_format.replace(a, b)
    return python_format.replace("T", "'T'") if "T" in python_format else python_format


def _shaped(t: Column, python_format: str) -> Column | None:
    """Whether t without its digits is what the format is without its directives, but for a sign; all that the format takes is.

    A text that no format takes costs an exception for each format it is tried with. None: the format has more than
    directives and plain separators.
    """
    rest = python_format
    for a in DIRECTIVES:
        rest = rest.replace(a, "")
    if any(ch not in "-/.,:; T年月日时分秒" for ch in rest):
        return None
    fits = F.translate(t, "t0123456789", "T").isin(rest, f"-{rest}", f"+{rest}")
    return fits & (F.length(t) >= 8) if python_format == "%Y%m%d" else fits


def day_value(t: Column, formats: list[str]) -> Column:
    """The day by the first format that fits a stripped text, else by an Excel serial."""
    tried = []
    if FULL_FORMATS <= {*formats} <= {*FULL_FORMATS, "%Y%m%d"}:  # no other format takes what these take
        tried.append(F.when(t.rlike(FULL_DAY), F.replace(F.left(t, F.lit(10)), F.lit("/"), F.lit("-")).try_cast("date")))
    for f in formats:
        parsed, fits = F.try_to_timestamp(t, F.lit(spark_format(f))).cast("date"), _shaped(t, f)
        tried.append(parsed if fits is None else F.when(fits, parsed))
    serial = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(*tried, F.when(serial.between(1, 2958465), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))))


def day(text: Column, formats: list[str]) -> Column:
    """struct(value, failed): the first format that fits, else an Excel serial; then the day."""
    return _checked(filled(ustrip(text)), lambda t: day_value(t, formats))


def clean_text(c: Column, chars: list[str] | None = None) -> Column:
    return blank_to_null(delete_chars(c, chars))


def normal_name(name: Column) -> Column:
    """A product name for comparison: lower case, no brackets or specification words, single spaces."""
    c = F.lower(name)
    c = F.regexp_replace(c, r"【[^】]*】|\[[^\]]*\]|\([^)]*\)|（[^）]*）", "")
    c = F.regexp_replace(c, "(?i)" + "|".join(SPEC_WORDS), "")
    return F.coalesce(ustrip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, " "), lambda w: w != "")), " ")


#: Characters of a name that one long holds with room for a carry.
WORD = 62


def similarity(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b) of two texts with sorted tokens: insertions and deletions count, nothing else.

    The longest common subsequence is found by the bits of one long, a step a character, where the shorter text has at
    most 62 characters, else by the rows of a table; both give the same number.
    """
    def scored(x: Column, y: Column) -> Column:
        total, short = F.length(x) + F.length(y), F.length(x) <= F.length(y)
        return let(F.when(short, x).otherwise(y), lambda s: let(F.when(short, y).otherwise(x), lambda t: F.when(F.length(s) == 0, 0.0).otherwise(200.0 * F.when(F.length(s) <= WORD, lcs_bits(s, t)).otherwise(lcs_table(s, t)) / total)))

    both = let(sorted_tokens(a), lambda x: let(sorted_tokens(b), lambda y: scored(x, y)))
    return F.coalesce(both, F.lit(0.0))


def lcs_bits(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of x, of 1 to 62 characters, and y.

    A bit is a position of x and is zero once the subsequence has grown there. A character of y turns the lowest set bit
    of each run that has it: adding the bits where x has the character carries past them.
    """
    full = (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(x)) - 1).cast("long")

    def places(letters: Column) -> Column:
        """Characters of x with the bits of their positions, the first position lowest: x is spelt anew with a 1 for the character and 0 for others."""
        size = F.length(letters)
        ones = F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.call_function("translate", F.reverse(x), letters, F.concat(F.repeat(F.lit("0"), i - 1), F.lit("1"), F.repeat(F.lit("0"), size - i))), 2, 10).cast("long"))
        return F.map_from_arrays(F.split(letters, ""), ones)

    def step(v: Column, at: Column) -> Column:
        return (v + v.bitwiseAND(at)).bitwiseOR(v.bitwiseAND(F.bitwise_not(at)))

    masks = let(F.array_join(F.array_distinct(F.split(x, "")), ""), lambda letters: let(places(letters), lambda m: F.transform(F.split(y, ""), lambda ch: F.coalesce(F.try_element_at(m, ch), F.lit(0).cast("long")))))
    return let(full, lambda ones: F.length(x) - F.bit_count(F.aggregate(masks, ones, lambda v, at: step(v, at).bitwiseAND(ones))))


def lcs_table(x: Column, y: Column) -> Column:
    """The same for texts of any length, by a row of the table for each character."""
    def lcs(chars: Column, others: Column) -> Column:
        def row(above: Column, ch: Column) -> Column:
            first = F.struct(F.lit(0).alias("left"), F.array(F.lit(0)).alias("row"))

            def cell(acc: Column, i: Column) -> Column:
                best = F.when(F.get(others, i - 1) == ch, F.get(above, i - 1) + 1).otherwise(F.greatest(F.get(above, i), acc["left"]))
                return F.struct(best.alias("left"), F.concat(acc["row"], F.array(best)).alias("row"))

            return F.aggregate(F.sequence(F.lit(1), F.size(others)), first, cell, lambda acc: acc["row"])

        return F.element_at(F.aggregate(chars, F.array_repeat(F.lit(0), F.size(others) + 1), row), -1)

    return lcs(F.split(x, ""), F.split(y, ""))


def weekday_name(d: Column) -> Column:
    from tallyhouse.schema import WEEKDAYS

    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(d) + 1)
