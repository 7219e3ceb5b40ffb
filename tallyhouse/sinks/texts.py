"""Texts of a collected report: the daily summary of at most 800 characters, the weekly one, and the digest."""

from __future__ import annotations

import datetime as dt

MOST = 800
MARKS = {"critical": "🔴", "warning": "⚠️"}


def money(v: float | None, wan: bool = False) -> str:
    if v is None:
        return "—"
    return f"¥{v / 10000:.2f}万" if wan and abs(v) >= 10000 else f"¥{v:,.2f}"


def change(v: float | None) -> str:
    return "—" if v is None else f"{'+' if v > 0 else ''}{v * 100:.1f}%"


def rate(v: float | None) -> str:
    return "—" if v is None else f"{v * 100:.1f}%"


def number(v: float | None) -> str:
    if v is None:
        return "—"
    return f"{int(v):,}" if float(v).is_integer() else f"{v:,.1f}"


def _overall(report: dict, wan: bool) -> list[str]:
    o = report["overview"]
    lines = [
        "◆ 整体",
        f"GMV {money(o['gmv'], wan)}｜环比 {change(o['gmv_dod'])}｜周同比 {change(o['gmv_wow'])}",
        f"实际成交 {money(o['net_amount'], wan)}｜退款率 {rate(o['refund_rate'])}｜支付件数 {number(o['paid_qty'])}｜买家数 {number(o['buyers'])}",
        f"客单价 {money(o['avg_order_value'], wan)}｜转化率 {rate(o['conversion_rate'])}｜推广ROI {number(o['roi'])}",
    ]
    if o["gross_profit"] is not None:
        lines.append(f"毛利 {money(o['gross_profit'], wan)}（率 {rate(o['gross_margin'])}）｜经营利润 {money(o['operating_profit'], wan)}")
    if (report.get("diagnosis") or {}).get("explanation"):
        lines.append(f"💡 归因：{report['diagnosis']['explanation']}")
    return lines + ([report["note"]] if report.get("note") else [])


def _marks(report: dict) -> dict[str, str]:
    """The mark of each channel's worst alert."""
    out: dict[str, str] = {}
    for a in report["anomalies"]:
        if a["scope"] == "platform" and out.get(a["subject"]) != MARKS["critical"]:
            out[a["subject"]] = MARKS.get(a["severity"], "")
    return out


def _compose(report: dict, company: str, at: dt.datetime, wan: bool, platforms: int | None, top: int, critical_only: bool, most_alerts: int | None) -> str:
    marks, alerts = _marks(report), report["anomalies"]
    by_net = top > 0
    lines = [f"【{company}电商销售日报】{report['report_date']} {report['weekday']}", "", *_overall(report, wan), "", "◆ 分平台"]
    for r in report["by_platform"][:platforms]:
        moved = r["net_amount_dod"] if by_net and r["net_amount_dod"] is not None else r["gmv_dod"]
        lines.append(f"· {r['platform_name']} {money(r['net_amount'], wan)}（环比 {change(moved)}）{marks.get(r['platform_name'], '')}")
    lines.append("")
    if best := report["top"]["by_gmv"][:top]:
        lines += ["◆ TOP3 单品", *[f"{i}. {t['name'][:20]} {money(t['net_amount'], wan)}（环比 {change(t['gmv_dod'])}）" for i, t in enumerate(best, 1)], ""]
    if critical_only:
        alerts = [a for a in alerts if a["severity"] == "critical"] or alerts
    alerts = alerts[:most_alerts]
    lines += ["◆ 需关注", *([f"· [{MARKS.get(a['severity'], '·')}] {a['message']}" for a in alerts] or ["· 本日无异常预警"]), ""]
    if report["data_completeness"]["warning"]:
        lines.append(report["data_completeness"]["warning"])
    return "\n".join([*lines, f"—— 由 电商日报工具 自动生成 {at:%Y-%m-%d %H:%M}"])


def daily_summary(report: dict, company: str = "", at: dt.datetime | None = None, wan: bool = False) -> str:
    """The fixed template; where it is too long, first the top products go, then channels, warnings and alerts."""
    at = at or dt.datetime.now()
    text = ""
    for platforms, top, critical_only, most in ((None, 3, False, None), (4, 0, False, None), (4, 0, True, None), (4, 0, True, 5), (2, 0, True, 2), (0, 0, True, 1)):
        text = _compose(report, company, at, wan, platforms, top, critical_only, most)
        if len(text) <= MOST:
            return text
    return text[: MOST - 1] + "…"


def weekly_summary(week: dict, company: str = "") -> str:
    t = week["totals"]
    wow = "基数不足" if t["wow_gmv"] is None else f"{t['wow_gmv'] * 100:+.1f}%"
    pp = "—" if t["wow_refund_rate_pp"] is None else f"{t['wow_refund_rate_pp']:+.1f}pp"
    known = t["total_gross_profit"] is not None and t["total_gross_margin"] is not None
    gross = f"综合毛利：¥{t['total_gross_profit']:,.0f}（毛利率：{t['total_gross_margin'] * 100:.1f}%）" if known else "综合毛利：—（SKU 成本价未维护，请到「SKU 档案」补全后重算）"
    refund = "• 退款率：—" if t["total_refund_rate"] is None else f"• 退款率：{t['total_refund_rate'] * 100:.1f}%（周变动：{pp}）"
    lines = [f"📊【{company} 电商销售周度复盘】", f"周期：{week['week_range_str']}", "-" * 30, "一、周度核心业绩", f"• 本周 GMV：¥{t['total_gmv']:,.0f}（周环比：{wow}）", f"• 实际成交：¥{t['total_net_amount']:,.0f} | {gross}", refund, "", "二、渠道业绩排名"]
    for p in week["platforms"][:4]:
        part = "" if p["gross_profit"] is None else f"，毛利 ¥{p['gross_profit']:,.0f}"
        lines.append(f"• {p['platform_name']}：GMV ¥{p['gmv']:,.0f}（占 {(p['share'] or 0) * 100:.0f}%{part}）")
    if week["top_skus"]:
        lines += ["", "三、本周核心爆款 Top 3", *[f"{i}. {s['name'][:18]}（¥{s['gmv']:,.0f}，销量 {s['paid_qty']} 件）" for i, s in enumerate(week["top_skus"][:3], 1)]]
    return "\n".join([*lines, "-" * 30, "💡 详细 7 天趋势明细与分商品数据已同步导出 Excel 报表。"])


#: What is said of a change in GMV by its main factor.
FALL = {"visitors": ("访客流量下滑", "商品访客数减少（引流不足）"), "conversion_rate": ("转化率受挫", "购买转化率下滑（承接力减弱）"), "avg_order_value": ("客单价走低", "客单价降低（低价件占比高或折扣加深）")}
RISE = {"visitors": ("访客流量增长", "商品访客增加（引流强劲）"), "conversion_rate": ("转化率提升", "购买转化率提升（转化承接高效）"), "avg_order_value": ("客单价拉升", "客单价拉升（高价爆款或连带率提升）")}


def explained(d: dict | None) -> dict | None:
    """An attribution row with label and explanation; None where it could not be made."""
    if not d or d["primary_driver"] is None:
        return None
    k, dod = d["primary_driver"], d["gmv_dod"]
    if k == "stable":
        return d | {"driver_label": "表现平稳", "explanation": "GMV 环比基本持平，各项指标波动在正常合理区间。"}
    label, why = (FALL if dod < 0 else RISE)[k]
    said = f"下滑 {abs(dod) * 100:.1f}%，主要由{why}拖累（贡献 {d[k] * 100:+.1f}pp）。" if dod < 0 else f"增长 {dod * 100:.1f}%，主要由{why}驱动（贡献 {d[k] * 100:+.1f}pp）。"
    return d | {"driver_label": label, "explanation": f"GMV 环比{said}"}


def digest(report: dict) -> str:
    """A short text of the report for a reader that knows nothing else."""
    o = report["overview"]
    lines = [f"日期 {report['report_date']}（{report['weekday']}）", f"GMV {money(o['gmv'])}，环比 {change(o['gmv_dod'])}，周同比 {change(o['gmv_wow'])}", f"实际成交 {money(o['net_amount'])}，退款率 {rate(o['refund_rate'])}，转化率 {rate(o['conversion_rate'])}，ROI {number(o['roi'])}"]
    lines += [f"{r['platform_name']}：实际成交 {money(r['net_amount'])}，占比 {rate(r['share'])}" for r in report["by_platform"]]
    lines += [f"{t['name']}：GMV {money(t['gmv'])}，环比 {change(t['gmv_dod'])}" for t in report["top"]["by_gmv"][:5]]
    return "\n".join([*lines, *[f"预警：{a['message']}" for a in report["anomalies"]]])
