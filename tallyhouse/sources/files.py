"""Channel export files: CSV, TSV, TXT, XLSX and XLSM into rows of text cells.

Spark reads the files (binaryFile), a task parses one file at a time, and each data row of a file becomes a row. A
file that can't be parsed gives one row with an error instead of failing the job.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from functools import cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schema import RetailError
from tallyhouse.sinks.xlsx import column
from tallyhouse.sources.spec import FileMatching

EXTENSIONS = (".csv", ".tsv", ".txt", ".xlsx", ".xlsm", ".xls")
SCAN = 200
MOST_BYTES = 50 * 1024 * 1024
INVISIBLE = re.compile("[\r\n﻿​‌‍⁠]")
PARSED = "path string, sha256 string, error_code string, error_message string, header array<string>, row_no long, cells array<string>, encoding string, header_row_index int, dropped_empty_rows long, warnings array<string>, sheet_name string, sheet_names array<string>"
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: Rows of a batch at most, but for the last file's.
BATCH = 10_000


def header_cell(c: object) -> str:
    return INVISIBLE.sub("", "" if c is None else str(c)).strip()


def unique_headers(names: list[str], warnings: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        if seen[n] > 1:
            warnings.append(f"表头“{n}”重复，已改名为“{n}_{seen[n]}”")
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def decode(raw: bytes, candidates: list[str]) -> tuple[str, str]:
    for name in candidates:
        try:
            return raw.decode(name), name
        except (UnicodeDecodeError, LookupError):
            continue
    from charset_normalizer import from_bytes

    if best := from_bytes(raw).best():
        return str(best), best.encoding
    raise RetailError("ENCODING_ERROR", f"none of {candidates} decodes the file")


def delimited(text: str) -> list[list[str]]:
    """Rows of a text: tabs if the first lines hold more of them than commas."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    first = [x for x in text.split("\n")[:20] if x.strip()][:10]
    tabs, commas = (sum(x.count(c) for x in first) for c in "\t,")
    return list(csv.reader(io.StringIO(text), delimiter="\t" if tabs > commas else ","))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_C, _V, _T = (f"{{{_NS['m']}}}{t}" for t in "cvt")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


#: Plain sheets, as programs write them: inline texts only, in columns from A on, rows in order.
_START = re.compile(r'(?:<\?xml version="1\.0"(?: encoding="(?:UTF|utf)-8")?(?: standalone="yes")?\?>\s*)?<worksheet[\s>]')
_ROW = re.compile(r'<row r="([1-9][0-9]{0,6})">')
_CELL = r'<c r="%s"(?: s="[0-9]+")? t="inlineStr"><is><t(?: xml:space="preserve")?>([^<]*)</t></is></c>'
_ANY = re.compile(_CELL % r"([A-Z]{1,3}[0-9]{1,7})")
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_CONTROL = bytes(sorted({*range(32)} - {9, 10}))


@cache
def _row_of(width: int) -> re.Pattern:
    """A plain row of so many cells."""
    return re.compile(r'<row r="([1-9][0-9]{0,6})">' + "".join(_CELL % (column(c) + r"\1") for c in range(width)) + "</row>")


def plain_rows(raw: bytes) -> list[list[str]] | None:
    """The rows of a plain sheet, as Workbook reads them; None of any other, which takes the XML parser.

    The parser makes an object of each of a cell's three elements, which costs more than all other steps of a file.
    """
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    at, end = text.find("<sheetData>"), text.rfind("</sheetData>")
    before, after = text[: max(at, 0)], text[max(end, 0) :].removeprefix("</sheetData>")
    if not 0 <= at < end or "<!" in before + after or not _START.match(before):
        return None
    # what the parser takes for no text, or reads as another
    if len(raw.translate(None, _CONTROL)) != len(raw) or any(x in text for x in ("]]>", "\ufffe", "\uffff")):
        return None
    entities = "&" in text
    if entities and re.search("&(?!(?:lt|gt|quot|apos|amp);)", text):
        return None
    try:
        root = ET.fromstring(f"{before}<sheetData/>{after}")
    except ET.ParseError:
        return None
    if root.tag != f"{{{_NS['m']}}}worksheet" or len(root.findall("m:sheetData", _NS)) != 1 or root.find("m:mergeCells", _NS) is not None:
        return None
    rows: list[list[str]] = []
    at, like = at + len("<sheetData>"), None
    while at < end:
        if like and (m := like.match(text, at)):
            number, *line = m.groups()
            at = m.end()
        else:
            if not (m := _ROW.match(text, at)):
                return None
            number, line, at = m[1], [], m.end()
            while m := _ANY.match(text, at):
                if m[1] != column(len(line)) + number:
                    return None
                line.append(m[2])
                at = m.end()
            if not text.startswith("</row>", at):
                return None
            at += len("</row>")
            like = _row_of(len(line))
        if int(number) <= len(rows):
            return None
        rows.extend([] for _ in range(int(number) - 1 - len(rows)))
        rows.append(line)
    while rows and not rows[-1]:  # a row without cells has no place at the end
        rows.pop()
    if entities:
        rows = [[unescape(t, _ENTITIES) if "&" in t else t for t in r] for r in rows]
    width = max(map(len, rows), default=0)
    return [r if len(r) == width else r + [""] * (width - len(r)) for r in rows]


class Workbook:
    """Sheets of an XLSX as rows of text; dates by their number format, merged ranges filled."""

    def __init__(self, raw: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
            book, rels = (ET.fromstring(self.zip.read(p)) for p in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise RetailError("FILE_PARSE_ERROR", f"not a readable workbook: {e}") from e
        target = {r.get("Id"): r.get("Target") for r in rels}
        self.sheets = {s.get("name"): target[s.get(_REL)] for s in book.findall("m:sheets/m:sheet", _NS)}
        names = self.zip.namelist()
        read = lambda p: ET.fromstring(self.zip.read(p)) if p in names else None
        shared, styles = read("xl/sharedStrings.xml"), read("xl/styles.xml")
        self.read: dict[str, list[list[str]]] = {}
        self.strings = [] if shared is None else ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in shared.findall("m:si", _NS)]
        self.dates: set[int] = set()
        if styles is not None:
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
            for i, xf in enumerate(styles.findall("m:cellXfs/m:xf", _NS)):
                n = int(xf.get("numFmtId", 0))
                plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, ""))
                if 14 <= n <= 22 or 45 <= n <= 47 or n in own and re.search("[ymdhs]", plain, re.I):
                    self.dates.add(i)

    def _text(self, c: ET.Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            if len(c) == 1 and len(c[0]) == 1 and c[0][0].tag == _T:
                return c[0][0].text or ""
            return "".join(t.text or "" for t in c.iter(_T))
        v = c.find(_V)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind in ("str", "e", "d"):
            return v.text
        x = float(v.text)
        if int(c.get("s", 0)) in self.dates:
            return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(x * 86400)))
        return str(int(x)) if x.is_integer() and re.fullmatch(r"-?\d+", v.text) else repr(x)

    def rows(self, sheet: str) -> list[list[str]]:
        """A sheet's rows of equal width. They are kept, since choosing a sheet reads it too; callers leave them as they are."""
        if sheet not in self.read:
            self.read[sheet] = self._rows(sheet)
        return self.read[sheet]

    def _rows(self, sheet: str) -> list[list[str]]:
        path = self.sheets[sheet].lstrip("/")
        raw = self.zip.read(path if path.startswith("xl/") else f"xl/{path}")
        if (plain := plain_rows(raw)) is not None:
            return plain
        root = ET.fromstring(raw)
        lines: dict[int, list[str | None]] = {}
        height = width = 0
        place: dict[str, int] = {}  # columns by their letters
        for r, row in enumerate(root.findall("m:sheetData/m:row", _NS)):
            number = row.get("r") or str(r + 1)
            at, digits = int(number) - 1, -len(number)
            for i, c in enumerate(row.findall(_C)):
                y, x, ref = at, i, c.get("r")
                if ref:
                    # most cells stand in the row that they name
                    x = place.get(ref[:digits], -1) if ref.endswith(number) else -1
                    if x < 0:
                        y, x = _place(ref)
                        if y == at and ref[:digits].isalpha() and ref.endswith(number):
                            place[ref[:digits]] = x
                line = lines.get(y)
                if line is None:
                    line = lines[y] = []
                    height = max(height, y + 1)
                if x >= len(line):
                    line.extend([None] * (x + 1 - len(line)))
                    width = max(width, x + 1)
                if (t := self._text(c)) is not None:
                    line[x] = t
        for m in root.findall("m:mergeCells/m:mergeCell", _NS):
            (y0, x0), (y1, x1) = map(_place, (m.get("ref") + ":" + m.get("ref")).split(":")[:2])
            if y0 < height and x0 < len(lines.get(y0, ())) and (t := lines[y0][x0]) is not None:
                for y in range(y0, min(y1, height - 1) + 1):
                    line = lines.setdefault(y, [])
                    line.extend([None] * (min(x1, width - 1) + 1 - len(line)))
                    for x in range(x0, min(x1, width - 1) + 1):
                        if line[x] is None:
                            line[x] = t
        return [[("" if t is None else t) for t in line] + [""] * (width - len(line)) for line in (lines.get(y, []) for y in range(height))]


class OldWorkbook:
    """Sheets of a BIFF workbook by name, cells as text: whole numbers read as floats."""

    def __init__(self, raw: bytes) -> None:
        try:
            import xlrd
        except ModuleNotFoundError as e:
            raise RetailError("FILE_PARSE_ERROR", "old .xls workbooks need the xlrd package; save the file as .xlsx") from e
        try:
            book = xlrd.open_workbook(file_contents=raw)
        except Exception as e:  # xlrd raises errors of many kinds on broken files
            raise RetailError("FILE_PARSE_ERROR", f"the .xls workbook can't be read: {type(e).__name__}") from e
        self.sheets = {n: book.sheet_by_name(n) for n in book.sheet_names()}

    def rows(self, name: str) -> list[list[str]]:
        sheet = self.sheets[name]
        return [["" if v is None else str(v) for v in sheet.row_values(i)] for i in range(sheet.nrows)]


def _sheet(book: Workbook | OldWorkbook, matching: FileMatching, warnings: list[str]) -> str:
    names = list(book.sheets)
    want = matching.sheet
    if not names:
        raise RetailError("FILE_PARSE_ERROR", "the workbook has no sheets")
    if want is None:
        return names[0]
    if want != "auto":
        for n in [want] if isinstance(want, str) else want:
            if n in names:
                return n
        raise RetailError("FILE_PARSE_ERROR", f"no sheet {want!r}", {"available_sheets": names})
    hints = set(matching.auto_header_hints)
    score = {n: max((sum(header_cell(c) in hints for c in r) for r in book.rows(n)[:SCAN]), default=0) for n in names}
    best = max(names, key=lambda n: score[n])
    if score[best]:
        return best
    warnings.append(f"没有工作表的表头命中 {sorted(hints)}，已用首个工作表“{names[0]}”（可用：{'、'.join(names)}）")
    return names[0]


def header_index(rows: list[list[str]], matching: FileMatching, warnings: list[str]) -> int:
    """0-based row of the header: fixed, else the row with most hint cells, else the first of two rows with two cells."""
    if matching.header_row != "auto":
        at = int(matching.header_row) - 1
        if not 0 <= at < len(rows):
            raise RetailError("FILE_PARSE_ERROR", f"header row {matching.header_row} is beyond the file's {len(rows)} rows")
        return at
    hints = set(matching.auto_header_hints)
    hits = [sum(header_cell(c) in hints for c in r) for r in rows[:SCAN]]
    if hits and max(hits):
        return hits.index(max(hits))
    filled = [sum(bool(header_cell(c)) for c in r) for r in rows[: SCAN + 1]]
    at = next((i for i, n in enumerate(filled[:SCAN]) if n >= 2 and any(m >= 2 for m in filled[i + 1 :])), 0)
    warnings.append(f"没有一行命中 {sorted(hints)}，推断表头为第 {at + 1} 行；文件前几行：{[[header_cell(c) for c in r][:8] for r in rows[:5]]}")
    return at


#: How workbooks of either kind start.
MAGIC = {"xlsx": b"PK\x03\x04", "xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"}


def parse(raw: bytes, filename: str, matching: FileMatching) -> dict:
    """One file: header, rows and what was noticed. Its content, not its name, tells a workbook from text."""
    extension = "." + filename.rpartition(".")[2].lower() if "." in filename else ""
    if extension not in (matching.extensions or EXTENSIONS):
        raise RetailError("FILE_PARSE_ERROR", f"files of type {extension!r} are not taken")
    if len(raw) > MOST_BYTES:
        raise RetailError("FILE_PARSE_ERROR", f"{len(raw)} bytes; files may have {MOST_BYTES}")
    warnings: list[str] = []
    meta = {"encoding": None, "sheet_name": None, "sheet_names": []}
    kind = next((k for k, start in MAGIC.items() if raw.startswith(start)), None)
    if kind:
        book = Workbook(raw) if kind == "xlsx" else OldWorkbook(raw)
        name = _sheet(book, matching, warnings)
        rows = book.rows(name)
        meta |= {"encoding": kind, "sheet_name": name, "sheet_names": list(book.sheets)}
    else:
        text, meta["encoding"] = decode(raw, matching.encoding_candidates)
        rows = delimited(text)
    if not rows:
        raise RetailError("FILE_PARSE_ERROR", "the file is empty")
    at = header_index(rows, matching, warnings)
    header = unique_headers([header_cell(c) for c in rows[at]], warnings)
    sized = [r if len(r) == len(header) else [*r[: len(header)], *[""] * (len(header) - len(r))] for r in rows[at + 1 :]]
    kept = [r for r in sized if any(map(str.strip, r))]
    dropped = len(sized) - len(kept)
    if matching.skip_footer:
        kept = kept[: -matching.skip_footer]
    return meta | {"header": header, "rows": kept, "header_row_index": at + 1, "dropped_empty_rows": dropped, "warnings": warnings}


def read(spark: SparkSession, paths: str | list[str], matching: FileMatching) -> DataFrame:
    """Rows of the files under paths; a file with no rows, or with an error, gives one row without cells."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return parsed(files, matching)


def parsed(files: DataFrame, matching: FileMatching, heads: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """files: path, content, sha256, one row each. heads: one row a file, without cells. only: the columns that are wanted; a file's header and notices would go with each of its rows."""
    shape = {c.split()[0]: c for c in PARSED.split(", ")}
    names = [n for n in shape if not only or n in only]
    types = pa.schema([(n, ARROW[shape[n].split()[1]]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {n: [] for n in names}
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(columns[n], types.field(n).type) for n in names], schema=types)
            for c in columns.values():
                c.clear()
            return out

        for files_of in batches:
            for path, content, digest in zip(*(files_of.column(n) for n in ("path", "content", "sha256")), strict=True):
                base = {"path": path.as_py(), "sha256": digest.as_py()}
                try:
                    got = base | parse(content.as_py(), base["path"].rpartition("/")[2], matching)
                except RetailError as e:
                    got = base | {"error_code": e.code, "error_message": e.message}
                rows = got.pop("rows", None)
                rows = [None] if heads or not rows else rows
                for i in range(0, len(rows), BATCH):
                    some = rows[i : i + BATCH]
                    first = None if some[0] is None else got["header_row_index"] + 1 + i
                    for n, c in columns.items():
                        c.extend(some if n == "cells" else (range(first, first + len(some)) if first is not None else [None]) if n == "row_no" else [got.get(n)] * len(some))
                    held += len(some)
                    if held >= BATCH:  # small files share a batch
                        yield batch()
                        held = 0
        if held:
            yield batch()

    return files.select("path", "content", "sha256").mapInArrow(run, ", ".join(shape[n] for n in names))
