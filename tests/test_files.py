"""Files, specifications and detection."""

import copy

import pytest
import yaml

from tallyhouse.schema import RetailError
from tallyhouse.sinks.xlsx import workbook
from tallyhouse.sources import files, spec

ANY = spec.FileMatching(extensions=list(files.EXTENSIONS), encoding_candidates=["utf-8", "gb18030"], auto_header_hints=["商品ID", "支付金额"])


def matching(**k):
    return spec.FileMatching(**{**ANY.__dict__, **k})


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk", "gb18030"])
def test_encodings(encoding):
    got = files.parse("商品ID,支付金额\nA,1\nB,2\n".encode(encoding), "x.csv", ANY)
    assert got["header"] == ["商品ID", "支付金额"] and got["rows"] == [["A", "1"], ["B", "2"]]


def test_header_and_rows():
    text = "标题\n\n商品ID,商品​ID,支付金额\nA,1\n,,\nB,2,3,4\n合计,1,1\n"
    got = files.parse(text.encode(), "x.txt", matching(skip_footer=1))
    assert got["header"] == ["商品ID", "商品ID_2", "支付金额"] and got["rows"] == [["A", "1", ""], ["B", "2", "3"]]
    assert got["header_row_index"] == 3 and got["dropped_empty_rows"] == 1 and got["warnings"]
    assert files.parse(text.encode(), "x.txt", matching(skip_footer=9))["rows"] == []


def test_header_fallback_and_fixed():
    got = files.parse(b"note\na,b\n1,2\n", "x.csv", ANY)
    assert got["header"] == ["a", "b"] and got["warnings"]
    assert files.parse(b"q\na,b\n1,2\n", "x.csv", matching(header_row=2))["header"] == ["a", "b"]
    with pytest.raises(RetailError):
        files.parse(b"q\n", "x.csv", matching(header_row=9))


def test_tabs_and_types():
    assert files.parse("商品ID\t支付金额\nA\t1,2\n".encode(), "x.tsv", ANY)["rows"] == [["A", "1,2"]]
    for name, raw in (("x.pdf", b"a"), ("x.csv", b""), ("x.xlsx", b"PK\x03\x04broken")):
        with pytest.raises(RetailError):
            files.parse(raw, name, ANY)


def test_workbooks():
    book = workbook([("说明", [["x"]], []), ("数据", [["商品ID", "支付金额"], ["=A", 1.5], ["B", 2]], ["text", "money"])])
    got = files.parse(book, "old.xls", ANY)
    assert got["sheet_name"] == "数据" and got["rows"] == [["'=A", "1.5"], ["B", "2"]] and got["sheet_names"] == ["说明", "数据"]
    assert files.parse(book, "x.xlsx", matching(sheet=None))["header"] == ["x"]
    assert files.parse(book, "x.xlsx", matching(sheet=["没有", "数据"]))["sheet_name"] == "数据"
    with pytest.raises(RetailError):
        files.parse(book, "x.xlsx", matching(sheet="没有"))


def test_bad_file_is_a_row(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("商品ID,支付金额\nA,1\n".encode())
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.csv").write_bytes("商品ID,支付金额\n".encode())
    rows = {r.path.rpartition("/")[2][0]: r for r in files.read(spark, str(tmp_path), ANY).collect()}
    assert rows["a"].cells == ["A", "1"] and rows["b"].error_code == "FILE_PARSE_ERROR" and rows["c"].cells is None and rows["c"].error_code is None


def test_builtin_channels():
    assert spec.builtin_keys() == ["doudian", "jd", "pinduoduo", "taobao"]
    jd = spec.builtin("jd")
    assert jd.metric_semantics["gmv_includes_shipping"] and "order_qty" in jd.transforms and spec.builtin("pinduoduo").file_matching.skip_footer == 2
    top = spec.detect(["日期", "商品编号", "下单金额"], "京东.csv")[0]
    assert top["platform_key"] == "jd" and top["score"] == 3 and 0 < top["confidence"] <= 1
    with pytest.raises(RetailError):
        spec.builtin("none")


@pytest.mark.parametrize(("change", "said"), [
    (lambda d: d["column_map"].update(x="nope"), "no field"), (lambda d: d["column_map"].update(x="gmv"), "twice"), (lambda d: d.update(required_columns=["category"]), "has no column"), (lambda d: d.update(extra=1), "unknown key"),
    (lambda d: d["transforms"].update(category={"type": "string"}), "not mapped"), (lambda d: d["metric_semantics"].update(net_amount_formula="gmv - sku_id"), "no numeric field"), (lambda d: d["metric_semantics"].update(platform_fee_rate=1), "platform_fee_rate"),
    (lambda d: d.update(dedup={"enabled": True}), "needs keys"), (lambda d: d["row_filters"].append({"column": "gmv", "op": "in"}), "needs values"), (lambda d: d["row_filters"].append({"column": "zzz", "op": "numeric"}), "neither"), (lambda d: d["file_matching"].pop("auto_header_hints"), "auto_header_hints"),
])
def test_checks(change, said):
    data = {
        "adapter_version": 1, "platform_key": "shop", "display_name": "Shop", "file_matching": {"auto_header_hints": ["id"]}, "column_map": {"id": "platform_product_code", "d": "stat_date", "g": "gmv"}, "required_columns": ["gmv"],
        "transforms": {"gmv": {"type": "money", "unit": "yuan"}}, "metric_semantics": {"gmv_basis": "paid", "gmv_includes_shipping": False, "gmv_includes_tax": False, "refund_handling": "none", "net_amount_formula": "gmv", "grain": "day"}, "row_filters": [],
    }
    assert spec.problems(data) == []
    assert spec.from_yaml(yaml.safe_dump(data)).dedup["enabled"] is False
    bad = copy.deepcopy(data)
    change(bad)
    assert any(said in p for p in spec.problems(bad))


def test_missing_column():
    with pytest.raises(RetailError) as e:
        spec.builtin("taobao").resolve(["商品ID"])
    assert e.value.code == "MISSING_REQUIRED_COLUMN" and "gmv" in e.value.detail["missing_columns"]


def test_old_workbook_sheets(monkeypatch):
    """The sheet rules hold for both kinds of workbook; xlrd is stood in for by a stub."""
    import sys
    import types

    class Sheet:
        def __init__(self, rows):
            self.rows, self.nrows = rows, len(rows)

        def row_values(self, i):
            return self.rows[i]

    sheets = {"说明": Sheet([["q"]]), "数据": Sheet([["商品ID", "支付金额"], ["A", 1.0], ["B", None]])}
    book = types.SimpleNamespace(sheet_names=lambda: list(sheets), sheet_by_name=sheets.get)
    stub = types.SimpleNamespace(open_workbook=lambda file_contents: book)
    monkeypatch.setitem(sys.modules, "xlrd", stub)
    raw = files.MAGIC["xls"] + b"..."
    for want in ("auto", "数据", ["无", "数据"]):
        got = files.parse(raw, "x.xls", matching(sheet=want))
        assert got["sheet_name"] == "数据" and got["rows"] == [["A", "1.0"], ["B", ""]] and got["encoding"] == "xls"
    assert files.parse(raw, "x.xls", matching(sheet=None))["sheet_name"] == "说明"
    for want in ("无", ["无"]):
        with pytest.raises(RetailError):
            files.parse(raw, "x.xls", matching(sheet=want))

    def broken(file_contents):
        raise AssertionError

    stub.open_workbook = broken
    with pytest.raises(RetailError):
        files.parse(raw, "x.xls", matching(sheet="auto"))
