"""What line items written as channel files and read back cost: plain sheets, plain cells, one write, and the same results as the slow ways."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import columns
from tallyhouse.operators.normalize import typed
from tallyhouse.plans import written
from tallyhouse.session import MOST_BYTECODE
from tallyhouse.sinks.xlsx import workbook
from tallyhouse.sources import files, generator, spec

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def sheet(body, more="", ns=MAIN):
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{ns}"><sheetData>{body}</sheetData>{more}</worksheet>'.encode()


def cell(ref, text, attributes=' t="inlineStr"'):
    return f'<c r="{ref}"{attributes}><is><t xml:space="preserve">{text}</t></is></c>'


def test_plain_sheets_need_no_parser(monkeypatch):
    """Sheets of texts, as the generator writes them, are read without an object for each element; the parser reads the same."""
    table = [["商品ID", "名 &<>\"'", ""], ["A", " x\ny\tz ", "]>"], ["B"], ["", "", "c"]]
    raw = workbook([("s", table, ["text"] * 3)], guard=False)
    book = files.Workbook(raw)
    assert files.plain_rows(book.zip.read("xl/worksheets/sheet1.xml")) is not None
    got = book.rows("s")
    monkeypatch.setattr(files, "plain_rows", lambda raw: None)
    assert got == files.Workbook(raw).rows("s") == [r + [""] * (3 - len(r)) for r in table]


def test_plain_rows_keep_their_places():
    assert files.plain_rows(sheet(f'<row r="2">{cell("A2", "a")}{cell("B2", "&amp;lt;")}</row><row r="4">{cell("A4", "b")}</row><row r="5"></row>')) == [["", ""], ["a", "&lt;"], ["", ""], ["b", ""]]
    assert files.plain_rows(sheet("")) == []


@pytest.mark.parametrize("raw", [
    sheet(f'<row r="1">{cell("B1", "a")}</row>'), sheet(f'<row r="1">{cell("A2", "a")}</row>'), sheet(f'<row r="2">{cell("A2", "a")}</row><row r="1">{cell("A1", "a")}</row>'), sheet(f'<row r="1">{cell("A1", "&#10;")}</row>'), sheet(f'<row r="1">{cell("A1", "a")}<!-- --></row>'),
    sheet('<row r="1"><c r="A1"><v>1</v></c></row>'), sheet(f'<row r="1">{cell("A1", "a")}</row>', '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>'), sheet(f'<row r="1">{cell("A1", "a")}</row>', ns="x"), sheet(f'<row r="1">{cell("A1", "]]>")}</row>'), sheet(f'<row r="1">{cell("A1", "a" + chr(13))}</row>'), sheet('<row r="1">', "<"), b"\xff",
])
def test_other_sheets_take_the_parser(raw):
    assert files.plain_rows(raw) is None


def test_cells_place_as_before():
    """The parser's own path: cells out of order, without a reference, named in another row, and merged ranges over rows without cells."""
    body = f'<row r="1">{cell("B1", "b")}{cell("A1", "a")}</row><row r="3">{cell("A3", "c")}<c t="inlineStr"><is><r><t>d</t></r><r><t>e</t></r></is></c>{cell("C4", "f")}</row>'
    book = files.Workbook(workbook([("s", [["x"]], ["text"])]))
    book.zip = type("Z", (), {"read": lambda self, p: sheet(body, '<mergeCells><mergeCell ref="A1:A2"/></mergeCells>')})()
    assert book.rows("s") == [["a", "b", ""], ["a", "", ""], ["c", "de", ""], ["", "", "f"]]


def test_small_and_broken_files_in_one_batch(spark):
    own = spec.builtin("taobao")
    made = spark.createDataFrame([(f"{i}.csv", bytearray(f"商品ID,支付金额\nA{i},1\nB{i},2\n".encode("gb18030")), str(i)) for i in range(50)] + [("x.csv", bytearray(b""), "x")], "path string, content binary, sha256 string").coalesce(1)
    rows = files.parsed(made, own.file_matching)
    got = {(r.path, r.row_no): (r.cells, r.header, r.error_code) for r in rows.collect()}
    assert got["7.csv", 3] == (["B7", "2"], ["商品ID", "支付金额"], None) and got["x.csv", None] == (None, None, "FILE_PARSE_ERROR") and len(got) == 101


def test_files_are_in_the_order_of_their_place(spark):
    """A struct orders as its fields do; rows come from Spark already sorted, over as many tasks as a shuffle has."""
    width = len(spec.builtin("jd").column_map)
    rows = spark.range(40).select((F.col("id") % 3).alias("file"), F.lit("2024-01-02").alias("until"), F.struct((F.col("id") % 4).alias("a"), F.col("id").alias("b")).alias("at"), F.array(*[F.col("id").cast("string")] * width).alias("cells"))
    made = generator.packed(rows, "jd")
    assert made.rdd.getNumPartitions() == 4
    got = {r.path: [x[0] for x in files.parse(bytes(r.content), r.path, spec.builtin("jd").file_matching)["rows"]] for r in made.collect()}
    assert got[generator.CHANNELS["jd"][0].format("20240102_00001")] == [str(i) for i in sorted(range(1, 40, 3), key=lambda i: (i % 4, i))] and len(got) == 3


def test_amounts_are_spelt_alike(spark):
    values = ["0.00", "0.05", "999.99", "1000.00", "1234.50", "999999.99", "1000000.00", "123456789012.34", "-0.01", "-1234.50", None]
    made = spark.createDataFrame([("taobao", Decimal(v) if v else None) for v in values], "platform_key string, gmv decimal(14,2)")
    rest = {"refund_amount": F.col("gmv"), "ad_cost": F.col("gmv"), "stat_date": F.lit(dt.date(2024, 1, 2)), "slash": F.lit(True), "kind": F.lit("plain"), "visitors": F.lit(1), "buyers": F.lit(1), "paid_qty": F.lit(1)}
    at = list(spec.builtin("taobao").column_map.values()).index("gmv")
    got = [(r.cells[at], r.cells[0]) for r in generator.cells(made.withColumns(rest), "taobao").select("cells").collect()]
    assert got == [(f"￥{Decimal(v):,.2f}" if v else "", "2024/01/02") for v in values]


def test_plain_cells_are_cast_as_others(spark, monkeypatch):
    """Plain amounts, whole numbers and days skip the double and the formats; the value is the same."""
    texts = ["0", "-0", "12", "12.5", "-12.55", "999999999999.99", "1234567890123.45", "00012.10", "12.345", "1e3", "1e99", "123456789012345", "1234567890123456", "12345678901234567", "-5", "+5", "2.5", "12\n", " 7 ", "x", "", "２",
             "2024-02-29", "2023-02-29", "2024-13-01", "2024/02/29", "2024-02/29", "0000-01-01", "2024-02-29 23:59:59", "2024-02-29 24:00:00", "2024-2-9", "20240229", "45293", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = spec.builtin("taobao").transforms["stat_date"]["formats"]
    value = lambda: [tuple(r) for r in rows.select(columns.money_value(F.col("t")), columns.whole_value(F.col("t")), columns.day_value(F.col("t"), formats).cast("string")).collect()]
    got = value()
    monkeypatch.setattr(columns, "AMOUNT", "^never$")
    monkeypatch.setattr(columns, "FULL_DAY", "^never$")
    monkeypatch.setattr(columns, "MOST_DIGITS", -1)
    assert got == value() and sum(v is not None for r in got for v in r) > 25


def test_wide_casts_are_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes: casts have Spark make smaller ones."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    own = spec.builtin("jd")
    typed(spark.createDataFrame([], "row_no long, cells array<string>"), list(own.column_map), own)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= MOST_BYTECODE == 8000


def test_all_channels_are_one_write(spark, sf_dir, monkeypatch):
    """One table by one job, of good rows and of the columns that the sums read."""
    kept = []
    monkeypatch.setattr(written, "stored", lambda df, *by: kept.append(df) or df)
    written.channel_files(spark, sf_dir)
    assert len(kept) == 1 and set(kept[0].columns) == set(written.READ)
