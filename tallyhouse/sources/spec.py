"""Channel specifications: how a channel's export becomes sales facts. Parsed, checked, listed and detected here.

A specification is a mapping, usually from YAML. The built-in ones share defaults.yaml; a user's must be complete.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import yaml

from tallyhouse.functions import formula
from tallyhouse.schema import MAPPABLE_FIELDS, NUMERIC_FIELDS, UNIFIED_FIELDS, RetailError

FOLDER = Path(__file__).parent / "channels"
LIST_OPS = ("in", "not_in", "contains", "not_contains")
SCALAR_OPS = ("gt", "gte", "lt", "lte", "eq", "neq")
OPS = ("not_null", "is_null", "numeric", *LIST_OPS, *SCALAR_OPS)
#: Allowed keys of every part; anything else is an error.
KEYS = {
    "": {"adapter_version", "platform_key", "display_name", "file_matching", "column_map", "column_aliases", "required_columns", "optional_columns", "transforms", "metric_semantics", "row_filters", "dedup"},
    "file_matching": {"extensions", "encoding_candidates", "sheet", "header_row", "auto_header_hints", "skip_footer", "detect_keywords", "detect_weight"},
    "transform": {"type", "formats", "truncate_to", "strip_chars", "unit", "default", "trim"},
    "filter": {"column", "op", "values", "value"},
    "metric_semantics": {"gmv_basis", "gmv_includes_shipping", "gmv_includes_tax", "refund_handling", "net_amount_formula", "timezone", "grain", "platform_fee_rate", "fulfillment_cost_per_unit"},
    "dedup": {"enabled", "keys", "strategy"},
}
CHOICES = {"gmv_basis": ("paid", "ordered", "shipped"), "refund_handling": ("separate", "deducted", "none"), "grain": ("sku_day", "order_line", "day")}


@dataclass(frozen=True)
class FileMatching:
    extensions: list[str] = field(default_factory=lambda: [".csv", ".xlsx"])
    encoding_candidates: list[str] = field(default_factory=lambda: ["utf-8"])
    sheet: str | list[str] | None = "auto"
    header_row: int | str = "auto"
    auto_header_hints: list[str] = field(default_factory=list)
    skip_footer: int = 0
    detect_keywords: list[str] = field(default_factory=list)
    detect_weight: float = 1.0


@dataclass(frozen=True)
class Spec:
    platform_key: str
    display_name: str
    adapter_version: int
    file_matching: FileMatching
    column_map: dict[str, str]
    column_aliases: dict[str, list[str]]
    required_columns: list[str]
    optional_columns: list[str]
    transforms: dict[str, dict]
    metric_semantics: dict
    row_filters: list[dict]
    dedup: dict

    def source_of(self, unified: str, header: list[str]) -> str | None:
        """The header cell that gives a field: the mapped one, else the first alias that is there."""
        names = [s for s, u in self.column_map.items() if u == unified] + self.column_aliases.get(unified, [])
        return next((n for n in names if n in header), None)

    def resolve(self, header: list[str]) -> dict[str, str]:
        """Unified field -> header cell; RetailError if a required field has none."""
        found = {u: s for u in self.column_map.values() if (s := self.source_of(u, header))}
        if missing := [c for c in self.required_columns if c not in found]:
            raise RetailError("MISSING_REQUIRED_COLUMN", f"no column for {missing}", {"missing_columns": missing, "detected_columns": header})
        return found


def problems(data: object) -> list[str]:
    """Everything that is wrong with a specification, as text."""
    if not isinstance(data, dict):
        return ["a specification must be a mapping"]
    bad: list[str] = []
    unknown = lambda part, d, at: bad.extend(f"{at}: unknown key {k!r}" for k in d if k not in KEYS[part])
    unknown("", data, "specification")
    for k in ("adapter_version", "platform_key", "display_name", "file_matching", "column_map", "required_columns", "metric_semantics"):
        if not data.get(k):
            bad.append(f"{k} is missing or empty")
    if not re.fullmatch("[a-z][a-z0-9_]*", str(data.get("platform_key", ""))):
        bad.append("platform_key must be snake_case")
    fm = data.get("file_matching") or {}
    unknown("file_matching", fm, "file_matching")
    if fm.get("header_row", "auto") == "auto" and not fm.get("auto_header_hints"):
        bad.append("file_matching: header_row auto needs auto_header_hints")
    if int(fm.get("skip_footer", 0)) < 0:
        bad.append("file_matching: skip_footer must not be negative")
    mapped, aliases = list((data.get("column_map") or {}).values()), data.get("column_aliases") or {}
    bad += [f"column_map: {u!r} is no field that a column may map to" for u in mapped if u not in MAPPABLE_FIELDS]
    bad += [f"column_map: {u!r} is mapped twice" for u in sorted({u for u in mapped if mapped.count(u) > 1})]
    for u, names in aliases.items():
        if u not in MAPPABLE_FIELDS or u not in mapped:
            bad.append(f"column_aliases: {u!r} is not mapped")
        if not names:
            bad.append(f"column_aliases: {u!r} has no names")
    bad += [f"required_columns: {u!r} has no column" for u in data.get("required_columns") or [] if u not in mapped and u not in aliases]
    for u, t in (data.get("transforms") or {}).items():
        unknown("transform", t, f"transforms.{u}")
        if u not in mapped:
            bad.append(f"transforms: {u!r} is not mapped")
        if t.get("type") not in ("datetime", "money", "integer", "string"):
            bad.append(f"transforms.{u}: unknown type {t.get('type')!r}")
        if t.get("type") == "datetime" and not t.get("formats"):
            bad.append(f"transforms.{u}: datetime needs formats")
        if t.get("type") == "money" and t.get("unit") not in ("yuan", "fen"):
            bad.append(f"transforms.{u}: money needs unit yuan or fen")
    sem = data.get("metric_semantics") or {}
    unknown("metric_semantics", sem, "metric_semantics")
    bad += [f"metric_semantics: {k} must be one of {v}" for k, v in CHOICES.items() if sem and sem.get(k) not in v]
    if not 0 <= float(sem.get("platform_fee_rate", 0)) < 1:
        bad.append("metric_semantics: platform_fee_rate must be in [0, 1)")
    if float(sem.get("fulfillment_cost_per_unit", 0)) < 0:
        bad.append("metric_semantics: fulfillment_cost_per_unit must not be negative")
    try:
        bad += [f"net_amount_formula: {n!r} is no numeric field" for n in sorted(formula.names(str(sem.get("net_amount_formula", "")))) if n not in NUMERIC_FIELDS]
    except RetailError as e:
        bad.append(e.message)
    dedup = data.get("dedup") or {}
    unknown("dedup", dedup, "dedup")
    if dedup.get("enabled", bool(dedup)) and not dedup.get("keys"):
        bad.append("dedup: enabled needs keys")
    if dedup.get("strategy", "sum") not in ("sum", "first", "last"):
        bad.append("dedup: unknown strategy")
    bad += [f"dedup: {k!r} is no field" for k in dedup.get("keys") or [] if k not in UNIFIED_FIELDS]
    headers = {*(data.get("column_map") or {}), *(n for names in aliases.values() for n in names or [])}
    for f in data.get("row_filters") or []:
        unknown("filter", f, "row_filters")
        if f.get("op") not in OPS:
            bad.append(f"row_filters: unknown op {f.get('op')!r}")
        if f.get("op") in LIST_OPS and not f.get("values"):
            bad.append(f"row_filters: {f['op']} needs values")
        if f.get("op") in SCALAR_OPS and f.get("value") is None:
            bad.append(f"row_filters: {f['op']} needs value")
        if f.get("column") not in UNIFIED_FIELDS and f.get("column") not in headers:
            bad.append(f"row_filters: {f.get('column')!r} is neither a field nor a header cell")
    return bad


def advice(spec: Spec) -> list[str]:
    """What is allowed but worth a look."""
    sem, out = spec.metric_semantics, []
    if not spec.file_matching.detect_keywords:
        out.append("detect_keywords 为空，将无法参与平台自动识别")
    if "gmv" not in spec.transforms:
        out.append("gmv 未配置 money 转换，非数值内容将按原样保留")
    if sem["gmv_includes_shipping"]:
        out.append("该平台 GMV 含运费，与其他平台不可直接相加比较（导出与看板会标注）")
    if sem["refund_handling"] == "none":
        out.append("该平台无退款数据，实际成交额未扣除退款（口径说明中会标注）")
    if float(sem.get("platform_fee_rate", 0)) == 0:
        out.append("platform_fee_rate 为 0：利润指标将不含平台扣点，请按经营类目实际扣点配置")
    return out


def semantics_note(spec: Spec) -> str:
    sem, yes = spec.metric_semantics, lambda b: "含" if b else "不含"
    lines = [
        f"GMV 口径：{ {'paid': '支付口径', 'ordered': '下单口径', 'shipped': '发货口径'}[sem['gmv_basis']]}（{sem['gmv_basis']}）", f"GMV 是否含运费：{yes(sem['gmv_includes_shipping'])}", f"GMV 是否含税：{yes(sem['gmv_includes_tax'])}",
        f"退款处理方式：{sem['refund_handling']}", f"实际成交额公式：{sem['net_amount_formula']}", f"数据粒度：{sem['grain']}", f"时区：{sem.get('timezone', 'Asia/Shanghai')}",
        f"平台扣点比例：{sem.get('platform_fee_rate', 0)}（0 表示利润不含扣点）", f"单件履约成本：{sem.get('fulfillment_cost_per_unit', 0)} 元/件",
    ]
    if sem["gmv_includes_shipping"]:
        lines.append(f"注意：{spec.display_name} 的 GMV 含运费，与其他平台不可直接相加比较")
    if sem["refund_handling"] == "none":
        lines.append("注意：退款数据缺失，实际成交额未扣除退款")
    return "\n".join(lines)


def from_mapping(data: dict) -> Spec:
    if bad := problems(data):
        raise RetailError("ADAPTER_CONFIG_INVALID", "; ".join(bad), {"errors": bad})
    sem = {"timezone": "Asia/Shanghai", "platform_fee_rate": 0, "fulfillment_cost_per_unit": 0} | data["metric_semantics"]
    return Spec(
        data["platform_key"], data["display_name"], int(data["adapter_version"]), FileMatching(**data["file_matching"]), data["column_map"], data.get("column_aliases") or {}, data["required_columns"],
        data.get("optional_columns") or [], data.get("transforms") or {}, sem, data.get("row_filters") or [], {"enabled": bool(data.get("dedup")), "keys": [], "strategy": "sum"} | (data.get("dedup") or {}),
    )


def from_yaml(text: str) -> Spec:
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RetailError("ADAPTER_CONFIG_INVALID", f"YAML: {e}") from e
    return from_mapping(data) if isinstance(data, dict) else from_mapping({"": data})


def _over(low: dict, high: dict) -> dict:
    out = copy.deepcopy(low)
    for k, v in high.items():
        out[k] = _over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def builtin_keys() -> list[str]:
    return sorted(p.stem for p in FOLDER.glob("*.yaml") if p.stem != "defaults")


@cache
def builtin(key: str) -> Spec:
    path = FOLDER / f"{key}.yaml"
    if key == "defaults" or not path.exists():
        raise RetailError("ADAPTER_NOT_FOUND", f"no built-in channel {key!r}")
    shared = yaml.safe_load((FOLDER / "defaults.yaml").read_text("utf-8"))
    data = _over(shared, yaml.safe_load(path.read_text("utf-8")))
    data["transforms"] = {u: t for u, t in data["transforms"].items() if u in data["column_map"].values()}
    spec = from_mapping(data)
    if spec.platform_key != key:
        raise RetailError("ADAPTER_CONFIG_INVALID", f"{path.name} is for {spec.platform_key!r}")
    return spec


def detect(columns: list[str], filename: str = "") -> list[dict]:
    """Built-in channels by the keywords found in the header and the file's name; confidence on the first only."""
    joined = " ".join(columns)
    rows = []
    for key in builtin_keys():
        spec = builtin(key)
        hits = sum((k in joined) + (k in filename) for k in spec.file_matching.detect_keywords if k)
        rows.append({"platform_key": key, "display_name": spec.display_name, "score": hits * spec.file_matching.detect_weight, "confidence": 0.0})
    rows.sort(key=lambda r: -r["score"])
    if rows and (total := sum(r["score"] for r in rows)):
        rows[0]["confidence"] = round(rows[0]["score"] / total, 4)
    return rows
