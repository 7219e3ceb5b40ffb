"""SQL for DuckDB over the same tables, written apart from the DataFrame plans that it is held against."""

from __future__ import annotations

DAY = "DATE '1996-07-07'"
FACTS = """
facts AS (
  SELECT l_orderkey AS upload_id, l_linenumber AS row_no, CAST(l_shipdate AS DATE) AS stat_date,
    CASE l_suppkey % 4 WHEN 0 THEN 'taobao' WHEN 1 THEN 'doudian' WHEN 2 THEN 'pinduoduo' ELSE 'jd' END AS platform_key,
    s_name AS shop_code, s_name AS shop_name, CAST(p_partkey AS VARCHAR) AS platform_product_code, p_name AS product_name, p_type AS category,
    CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS sku_id, CAST(l_quantity AS BIGINT) AS paid_qty, g AS gmv, r AS refund_amount,
    CAST(g - r AS DECIMAL(14,2)) AS net_amount, CAST(l_quantity AS BIGINT) * 8 + l_orderkey % 40 AS visitors,
    greatest(1, CAST(l_quantity AS BIGINT) * 4 // 5) AS buyers, CAST(round(g * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS ad_cost
  FROM (
    SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS g,
      CASE WHEN l_returnflag = 'R' THEN CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) ELSE CAST(0 AS DECIMAL(14,2)) END AS r
    FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
skus AS (
  SELECT p_partkey AS id, 'K' || p_partkey AS sku_code, p_name AS name, p_type AS category,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(round(CAST(p_retailprice AS DECIMAL(14,2)) * CAST(0.6 AS DECIMAL(3,1)), 2) AS DECIMAL(14,2)) END AS cost_price
  FROM part WHERE p_partkey % 5 <> 0),
channels(platform_key, display_name, fee, piece, shipping) AS (VALUES
  ('taobao', '淘宝/天猫（生意参谋）', CAST(0.05 AS DECIMAL(10,6)), CAST(1.5 AS DECIMAL(14,4)), false), ('doudian', '抖音电商（抖店罗盘）', CAST(0.03 AS DECIMAL(10,6)), CAST(2 AS DECIMAL(14,4)), false),
  ('pinduoduo', '拼多多（商家后台）', CAST(0 AS DECIMAL(10,6)), CAST(0 AS DECIMAL(14,4)), false), ('jd', '京东（京东商智）', CAST(0 AS DECIMAL(10,6)), CAST(0 AS DECIMAL(14,4)), true)),
costed AS (
  SELECT *, CASE WHEN cogs IS NOT NULL THEN net_amount - cogs - coalesce(platform_fee, 0) - coalesce(fulfillment_cost, 0) END AS gross_profit,
    CASE WHEN cogs IS NOT NULL THEN net_amount END AS covered_net
  FROM (SELECT facts.*, display_name, sku_code, name AS sku_name, CAST(round(cost_price * paid_qty, 2) AS DECIMAL(24,2)) AS cogs, CAST(round(net_amount * fee, 2) AS DECIMAL(24,2)) AS platform_fee, CAST(round(paid_qty * piece, 2) AS DECIMAL(24,2)) AS fulfillment_cost
    FROM facts LEFT JOIN skus ON sku_id = id LEFT JOIN channels USING (platform_key))),
weekly_costed AS (
  SELECT * REPLACE (CASE WHEN exact_cogs IS NOT NULL THEN net_amount - exact_cogs - net_amount * fee - paid_qty * piece END AS gross_profit)
  FROM (SELECT costed.*, cost_price * paid_qty AS exact_cogs, fee, piece FROM costed LEFT JOIN skus ON sku_id = id LEFT JOIN channels USING (platform_key)))
"""
SUMMED = ["gmv", "refund_amount", "net_amount", "paid_qty", "buyers", "visitors", "ad_cost", "gross_profit", "covered_net"]
BACK = {0: 0, 1: 1, 2: 7}
QUOTIENT = {"refund_rate": ("refund_amount", "gmv"), "conversion_rate": ("buyers", "visitors"), "avg_order_value": ("net_amount", "buyers"), "unit_price": ("net_amount", "paid_qty"), "roi": ("net_amount", "ad_cost"), "ad_cost_ratio": ("ad_cost", "net_amount"), "gross_margin": ("gross_profit", "covered_net")}
AMOUNTS = ["gmv", "net_amount", "refund_amount", "paid_qty", "buyers", "visitors", "ad_cost", "avg_order_value", "unit_price", "gross_profit", "operating_profit", "roi", "ad_cost_ratio"]
RATIOS = ["refund_rate", "conversion_rate", "gross_margin"]


#: The same facts with all sales dealt to the first 40 products.
DENSE = FACTS.replace("    FROM lineitem)", "    FROM (SELECT * REPLACE (l_partkey % 40 + 1 AS l_partkey) FROM lineitem))")


def query(body: str, dense: bool = False) -> str:
    return f"WITH {DENSE if dense else FACTS} {body}"


def listed(where: str, order: str, dense: bool = False) -> str:
    order = f"{order}, coalesce(net_amount, 0) DESC, sku_id"
    return query(f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({TOP} WHERE {where} ORDER BY {order} LIMIT 10)", dense)


def sums(fields: list[str] | None = None) -> str:
    return ", ".join(f"CAST(sum({f}) FILTER (stat_date = {DAY} - {b}) AS DOUBLE) AS {f}_{p}" for p, b in BACK.items() for f in fields or SUMMED)


def value(m: str, p: int) -> str:
    if m in QUOTIENT:
        a, b = QUOTIENT[m]
        return f"({a}_{p} / nullif({b}_{p}, 0))"
    return f"(gross_profit_{p} - coalesce(ad_cost_{p}, 0))" if m == "operating_profit" else f"{m}_{p}"


def blocks(compare: bool = True, wow: bool = True) -> str:
    out = []
    for m in AMOUNTS:
        out.append(f"round({value(m, 0)}, 2) AS {m}")
        out += [f"round(({value(m, 0)} - {value(m, p)}) / nullif({value(m, p)}, 0), 4) AS {m}_{n}" if compare and (wow or p == 1) else f"CAST(NULL AS DOUBLE) AS {m}_{n}" for p, n in ((1, "dod"), (2, "wow"))]
    for m in RATIOS:
        out.append(f"round({value(m, 0)}, 4) AS {m}")
        out += [f"round(({value(m, 0)} - {value(m, p)}) * 100, 4) AS {m}_{n}_pp" if compare and (wow or p == 1) else f"CAST(NULL AS DOUBLE) AS {m}_{n}_pp" for p, n in ((1, "dod"), (2, "wow"))]
    return ", ".join(out)


def grouped(keys: str, extra: str = "", where: str = "true") -> str:
    return f"(SELECT {keys}, {extra} {sums()} FROM costed WHERE {where} AND stat_date IN ({DAY}, {DAY} - 1, {DAY} - 7) GROUP BY {keys} HAVING count(*) FILTER (stat_date = {DAY}) > 0)"


SHARE = "round(net_amount_0 / nullif(sum(net_amount_0) OVER (), 0), 4) AS share"
SKU_ROWS = f"""(SELECT sku_id, sku_code, sku_name AS name, category, platforms, round(gmv_1, 2) AS gmv_yesterday, {blocks()}
  FROM {grouped('sku_id', f"any_value(sku_code) AS sku_code, any_value(sku_name) AS sku_name, any_value(category) AS category, array_to_string(list_sort(list_distinct(list(display_name) FILTER (stat_date = {DAY}))), '、') AS platforms, ", 'sku_id IS NOT NULL')})"""
TOP = "SELECT sku_id, sku_code, name, category, gmv, net_amount, refund_rate, gmv_dod FROM " + SKU_ROWS


def context(scope: str, keys: str, subject: str, where: str = "true") -> str:
    names = {"refund_rate": value("refund_rate", 0), "conversion_rate": value("conversion_rate", 0), "roi": value("roi", 0), "ad_cost_ratio": value("ad_cost_ratio", 0), "gmv_dod": "(gmv_0 - gmv_1) / nullif(gmv_1, 0)", "conversion_rate_dod_pp": f"({value('conversion_rate', 0)} - {value('conversion_rate', 1)}) * 100"}
    base = f"(SELECT {subject} AS subject, {sums()} FROM costed WHERE {where} AND stat_date IN ({DAY}, {DAY} - 1, {DAY} - 7) GROUP BY {keys} HAVING count(*) FILTER (stat_date = {DAY}) > 0)"
    return " UNION ALL ".join(f"SELECT '{scope}' AS scope, subject, '{m}' AS metric, {e} AS value, coalesce(gmv_0, 0) AS gmv FROM {base}" for m, e in names.items())


RULES = """rules(rule_id, rule_name, metric, scope, operator, threshold, min_base) AS (VALUES (1, 'GMV 环比大幅波动', 'gmv_dod', 'platform', 'abs_gt', 0.30, 1000), (2, 'SKU GMV 环比骤降', 'gmv_dod', 'sku', 'lt', -0.40, 500),
 (3, '退款率超限', 'refund_rate', 'sku', 'gt', 0.15, 500), (4, '整体退款率超限', 'refund_rate', 'overall', 'gt', 0.20, 0), (5, '转化率异常下滑', 'conversion_rate_dod_pp', 'platform', 'lt', -2.0, 1000), (6, '推广 ROI 过低', 'roi', 'platform', 'lt', 1.0, 500))"""


def alerts(scope: str, keys: str, subject: str, where: str = "true", facts: str = FACTS, rules: str = RULES) -> str:
    return f"""WITH {facts}, {rules}, ctx AS ({context(scope, keys, subject, where)}),
 fired AS (SELECT *, CASE WHEN threshold = 0 THEN 0.0 WHEN operator = 'abs_gt' THEN (abs(value) - abs(threshold)) / abs(threshold) WHEN operator = 'lt' THEN (threshold - value) / abs(threshold) ELSE (value - threshold) / abs(threshold) END AS over
  FROM ctx JOIN (SELECT * REPLACE (CAST(threshold AS DOUBLE) AS threshold) FROM rules) USING (scope, metric) WHERE value IS NOT NULL AND gmv >= min_base
   AND CASE operator WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE abs(value) > threshold END)
SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name, CASE WHEN over > 1 THEN 'critical' ELSE 'warning' END AS severity, scope, subject, metric, round(value, 6) AS value, threshold, round(over, 6) AS overshoot FROM fired"""


WEEK = f"date_trunc('week', {DAY})::DATE"
WEEKLY = ["gmv", "net_amount", "refund_amount", "paid_qty", "buyers", "ad_cost"]


def weekly_sums(tag: str, where: str) -> str:
    zero = [f"CAST(coalesce(sum({c}) FILTER ({where}), 0) AS DOUBLE) AS {tag}_{c}" for c in WEEKLY]
    return ", ".join([*zero, f"CAST(sum(gross_profit) FILTER ({where}) AS DOUBLE) AS {tag}_gross_profit", f"CAST(sum(net_amount) FILTER ({where} AND gross_profit IS NOT NULL) AS DOUBLE) AS {tag}_covered_net", f"count(*) FILTER ({where}) AS {tag}_rows"])


def over(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} END)"


def weekly_value(m: str, t: str) -> str:
    return {
        "refund_rate": over(f"{t}_refund_amount", f"{t}_gmv"), "gross_margin": over(f"{t}_gross_profit", f"{t}_covered_net"), "roi": over(f"{t}_net_amount", f"{t}_ad_cost"),
        "avg_order_value": f"(CASE WHEN {t}_buyers > 0 THEN {over(f'{t}_net_amount', f'{t}_buyers')} ELSE {over(f'{t}_net_amount', f'{t}_paid_qty')} END)",
    }.get(m, f"{t}_{m}")


def wow(m: str) -> str:
    c, p = weekly_value(m, "c"), weekly_value(m, "p")
    return f"round(CASE WHEN {p} > 0 THEN ({c} - {p}) / {p} END, 6) AS wow_{m}"


def weekly_totals() -> str:
    out = []
    for m in ("gmv", "net_amount", "refund_amount", "gross_profit", "avg_order_value", "roi"):
        out += [f"round({weekly_value(m, 'c')}, 2) AS total_{m}", f"CASE WHEN p_rows > 0 THEN round({weekly_value(m, 'p')}, 2) END AS prev_{m}", wow(m)]
    out += ["CAST(c_paid_qty AS BIGINT) AS total_paid_qty", "CASE WHEN p_rows > 0 THEN CAST(p_paid_qty AS BIGINT) END AS prev_paid_qty", wow("paid_qty")]
    for m in ("refund_rate", "gross_margin"):
        c, p = weekly_value(m, "c"), weekly_value(m, "p")
        out += [f"round({c}, 4) AS total_{m}", f"CASE WHEN p_rows > 0 THEN round({p}, 4) END AS prev_{m}", f"CASE WHEN p_rows > 0 THEN round(({c} - {p}) * 100, 2) END AS wow_{m}_pp"]
    return query(f"SELECT {', '.join(out)} FROM (SELECT {weekly_sums('c', f'stat_date BETWEEN {WEEK} AND {WEEK} + 6')}, {weekly_sums('p', f'stat_date BETWEEN {WEEK} - 7 AND {WEEK} - 1')} FROM weekly_costed)")


THIS_WEEK = f"stat_date BETWEEN {WEEK} AND {WEEK} + 6"
WEEKDAYS = "CASE isodow(stat_date) WHEN 1 THEN '周一' WHEN 2 THEN '周二' WHEN 3 THEN '周三' WHEN 4 THEN '周四' WHEN 5 THEN '周五' WHEN 6 THEN '周六' ELSE '周日' END"
ROLLING = "CAST(sum(refund_amount) FILTER (stat_date BETWEEN {d} - 6 AND {d}) AS DOUBLE) / nullif(CAST(sum(gmv) FILTER (stat_date BETWEEN {d} - 6 AND {d}) AS DOUBLE), 0)"


def _rolling() -> str:
    r = [ROLLING.format(d=f"({DAY} - {b})") for b in (0, 1, 7)]
    return query(f"SELECT round(a, 4) AS refund_rate_7d, round((a - b) * 100, 4) AS refund_rate_7d_dod_pp, round((a - c) * 100, 4) AS refund_rate_7d_wow_pp FROM (SELECT {r[0]} AS a, {r[1]} AS b, {r[2]} AS c FROM facts)")


TREND = f"""(SELECT d AS stat_date, round(CAST(sum(gmv) AS DOUBLE), 2) AS gmv, round(CAST(sum(net_amount) AS DOUBLE), 2) AS net_amount, round(CAST(sum(refund_amount) AS DOUBLE) / nullif(CAST(sum(gmv) AS DOUBLE), 0), 4) AS refund_rate
 FROM (SELECT CAST(unnest(range({DAY} - 29, {DAY} + 1, INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN facts ON stat_date = d GROUP BY d)"""


def _attribution() -> str:
    return query(f"""SELECT round((g1 - g0) / g0, 4) AS gmv_dod, v AS visitors, c AS conversion_rate, a AS avg_order_value,
 CASE WHEN (g1 - g0) / g0 < -0.005 THEN CASE least(v, c, a) WHEN v THEN 'visitors' WHEN c THEN 'conversion_rate' ELSE 'avg_order_value' END WHEN (g1 - g0) / g0 > 0.005 THEN CASE greatest(v, c, a) WHEN v THEN 'visitors' WHEN c THEN 'conversion_rate' ELSE 'avg_order_value' END ELSE 'stable' END AS primary_driver
 FROM (SELECT *, round(w * ln(v1 / v0) / g0, 4) AS v, round(w * ln((b1 / v1) / (b0 / v0)) / g0, 4) AS c, round(w * ln((g1 / b1) / (g0 / b0)) / g0, 4) AS a FROM
 (SELECT *, CASE WHEN abs(g1 - g0) < 1e-9 THEN g0 ELSE (g1 - g0) / ln(g1 / g0) END AS w FROM (SELECT gmv_0 AS g1, visitors_0 AS v1, buyers_0 AS b1, gmv_1 AS g0, visitors_1 AS v0, buyers_1 AS b0 FROM (SELECT {sums(['gmv', 'visitors', 'buyers'])} FROM facts))))""")


def _values() -> str:
    one = lambda m, digits: f"SELECT '{m}' AS metric, " + ", ".join(f"round({value(m, p)}, {digits}) AS {n}" for p, n in ((0, "today"), (1, "dod_value"), (2, "wow_value"))) + " FROM s"
    return f"WITH {FACTS}, s AS (SELECT {sums()} FROM costed) " + " UNION ALL ".join([one(m, 2) for m in AMOUNTS] + [one(m, 4) for m in RATIOS])


SQL = {
    "overall_dod_wow": query(f"SELECT {blocks()} FROM (SELECT {sums()} FROM costed)"),
    "overall_metrics": query(f"SELECT {blocks(compare=False)} FROM (SELECT {sums()} FROM costed)"),
    "overall_values": _values(),
    "refund_rate_7d": _rolling(),
    "rolling_7d_series": query("SELECT platform_key, stat_date, round(CAST(sum(r) OVER w AS DOUBLE) / nullif(CAST(sum(g) OVER w AS DOUBLE), 0), 4) AS refund_rate_7d FROM (SELECT platform_key, stat_date, sum(refund_amount) AS r, sum(gmv) AS g FROM facts GROUP BY ALL) WINDOW w AS (PARTITION BY platform_key ORDER BY stat_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"),
    "by_platform": query(f"SELECT platform_key, display_name AS platform_name, {blocks()}, {SHARE} FROM {grouped('platform_key', 'any_value(display_name) AS display_name, ')}"),
    "by_shop": query(f"SELECT platform_key, shop_code, shop_name, display_name AS platform_name, display_name || ' · ' || shop_name AS display, {blocks()}, {SHARE} FROM {grouped('platform_key, shop_code, shop_name', 'any_value(display_name) AS display_name, ')}"),
    "by_category": query(f"SELECT category, category AS display, {blocks()}, {SHARE} FROM {grouped('category')}"),
    "share_of_net": query(f"SELECT category, {SHARE} FROM {grouped('category')}"),
    "by_sku_mapped": query(f"SELECT * FROM {SKU_ROWS}"),
    "by_sku_unmapped": query(f"SELECT platform_key, platform_product_code, product_name, {blocks(wow=False)} FROM {grouped('platform_key, platform_product_code', 'any_value(product_name) AS product_name, ', 'sku_id IS NULL')}"),
    "daily_trend_30d": query(f"SELECT * FROM {TREND}"),
    "trend_promo_flags": query(f"SELECT stat_date, gmv, coalesce(gmv >= 2 * m, false) AS is_promo FROM {TREND}, (SELECT CASE WHEN len(v) >= 4 THEN v[len(v) // 2 + 1] END AS m FROM (SELECT list_sort(list(gmv) FILTER (gmv IS NOT NULL)) AS v FROM {TREND}))"),
    "top_gmv": listed("true", "gmv DESC"),
    "top_growth": listed("gmv_yesterday > 1000 AND gmv_dod > 0", "gmv_dod DESC", True),
    "top_decline": listed("gmv_yesterday > 1000 AND gmv_dod <= 0", "gmv_dod", True),
    "top_refund": listed("gmv > 500 AND refund_rate IS NOT NULL", "refund_rate DESC"),
    "profit_rows": query(f"SELECT upload_id, CAST(row_no AS BIGINT) AS row_no, CAST(cogs AS DOUBLE) AS cogs, CAST(platform_fee AS DOUBLE) AS platform_fee, CAST(fulfillment_cost AS DOUBLE) AS fulfillment_cost, CAST(gross_profit AS DOUBLE) AS gross_profit FROM costed WHERE stat_date BETWEEN {DAY} - 29 AND {DAY}"),
    "profit_summary": query(f"SELECT platform_key, round(CAST(sum(gross_profit) AS DOUBLE), 2) AS gross_profit, round(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(covered_net) AS DOUBLE), 0), 4) AS gross_margin, round(CAST(sum(gross_profit) - coalesce(sum(ad_cost), 0) AS DOUBLE), 2) AS operating_profit FROM costed WHERE stat_date BETWEEN {DAY} - 29 AND {DAY} GROUP BY 1"),
    "cost_coverage": query(f"SELECT CASE WHEN sum(net_amount) <> 0 THEN coalesce(round(CAST(sum(covered_net) AS DOUBLE) / CAST(sum(net_amount) AS DOUBLE), 4), 0) END AS cost_coverage FROM costed WHERE stat_date = {DAY}"),
    "gmv_attribution": _attribution(),
    "anomalies_overall": alerts("overall", "ALL", "'整体'", rules=RULES.replace("'overall', 'gt', 0.20", "'overall', 'gt', 0.001")),
    "anomalies_platform": alerts("platform", "platform_key", "any_value(display_name)"),
    "anomalies_sku": alerts("sku", "sku_id", "any_value(sku_code || ' ' || sku_name)", "sku_id IS NOT NULL", DENSE),
    "missing_platforms": query(f"SELECT platform_key, display_name FROM channels WHERE platform_key NOT IN (SELECT platform_key FROM facts WHERE stat_date = {DAY} AND platform_key IN ('jd', 'taobao'))"),
    "shipping_note": query(f"SELECT nullif(string_agg('*' || display_name || 'GMV含运费', '、' ORDER BY platform_key), '') AS note FROM channels WHERE shipping AND platform_key IN (SELECT platform_key FROM facts WHERE stat_date BETWEEN {DAY} - 29 AND {DAY})"),
    "scope_filter": query(f"SELECT {blocks()} FROM (SELECT {sums()} FROM costed WHERE platform_key IN ('jd', 'taobao') AND (shop_code IN ('Supplier#000000003', 'Supplier#000000004') OR shop_name IN ('Supplier#000000003', 'Supplier#000000004', 'Supplier#000000007')))"),
    "weekly_totals": weekly_totals(),
    "weekly_daily": query(f"""SELECT d AS stat_date, {WEEKDAYS.replace('stat_date', 'd')} AS weekday, round(c_gmv, 2) AS gmv, round(c_net_amount, 2) AS net_amount, round({weekly_value('refund_rate', 'c')}, 4) AS refund_rate, round(c_gross_profit, 2) AS gross_profit, round({weekly_value('gross_margin', 'c')}, 4) AS gross_margin, CAST(c_paid_qty AS BIGINT) AS paid_qty, round({weekly_value('avg_order_value', 'c')}, 2) AS avg_order_value, round({weekly_value('roi', 'c')}, 2) AS roi
 FROM (SELECT d, {weekly_sums('c', 'stat_date IS NOT NULL')} FROM (SELECT CAST(unnest(range({WEEK}, {WEEK} + 7, INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN weekly_costed ON stat_date = d GROUP BY d)"""),
    "weekly_platforms": query(f"SELECT platform_key, n AS platform_name, round(c_gmv, 2) AS gmv, round({over('c_gmv', 'w')}, 4) AS share, round(c_net_amount, 2) AS net_amount, round({weekly_value('refund_rate', 'c')}, 4) AS refund_rate, round(c_gross_profit, 2) AS gross_profit, round(CASE WHEN p_gmv > 0 THEN (c_gmv - p_gmv) / p_gmv END, 6) AS wow_gmv FROM (SELECT platform_key, any_value(display_name) AS n, {weekly_sums('c', THIS_WEEK)}, {weekly_sums('p', f'stat_date BETWEEN {WEEK} - 7 AND {WEEK} - 1')} FROM weekly_costed GROUP BY platform_key), (SELECT CAST(sum(gmv) AS DOUBLE) AS w FROM facts WHERE {THIS_WEEK}) WHERE c_rows > 0"),
    "weekly_top_skus": query(f"SELECT key, name, platform, round(g, 2) AS gmv, round(r, 2) AS refund_amount, q AS paid_qty, round({over('r', 'g')}, 4) AS refund_rate, round({over('g', 'w')}, 4) AS share FROM (SELECT coalesce(sku_code, platform_product_code) AS key, arg_min(product_name, (upload_id, row_no)) AS name, arg_min(display_name, (upload_id, row_no)) AS platform, CAST(sum(gmv) AS DOUBLE) AS g, CAST(sum(refund_amount) AS DOUBLE) AS r, CAST(sum(paid_qty) AS BIGINT) AS q FROM costed WHERE {THIS_WEEK} GROUP BY 1), (SELECT CAST(sum(gmv) AS DOUBLE) AS w FROM facts WHERE {THIS_WEEK}) ORDER BY g DESC, key LIMIT 10"),
    "meta_platforms": query("SELECT DISTINCT platform_key FROM facts"),
    "meta_categories": query("SELECT DISTINCT category FROM facts"),
    "meta_shops": query("SELECT DISTINCT platform_key, shop_code, shop_name FROM facts"),
    "latest_date": query("SELECT max(stat_date) AS latest_date FROM facts"),
    "upload_totals": query("SELECT CAST(sum(n) AS BIGINT) AS valid, CAST(sum(u) AS BIGINT) AS unmapped_codes, max(m) AS latest_date FROM (SELECT upload_id, count(*) AS n, count(DISTINCT platform_key || '/' || platform_product_code) FILTER (sku_id IS NULL) AS u, max(stat_date) AS m FROM facts GROUP BY 1)"),
    "group_keys": query("SELECT DISTINCT platform_key || '_' || shop_code AS shop, platform_key || '_' || coalesce(CAST(sku_id AS VARCHAR), 'None') AS sku FROM facts"),
    "report_sources": query(f"SELECT o_orderkey AS id, '订单' || o_orderkey || '.csv' AS filename FROM orders WHERE o_orderkey IN (SELECT upload_id FROM facts WHERE stat_date = {DAY})"),
    "upload_unmapped_count": query("SELECT platform_key, count(DISTINCT platform_product_code) FILTER (sku_id IS NULL) AS unmapped_codes, max(stat_date) AS last_date FROM facts GROUP BY 1"),
}
_SECTIONS = {"platform": "by_platform", "shop": "by_shop", "category": "by_category", "sku": "by_sku_mapped", "unmapped": "by_sku_unmapped"}
SQL["report_sections"] = query(" UNION ALL BY NAME ".join(f"SELECT '{s}' AS section, * FROM ({SQL[q].removeprefix(f'WITH {FACTS} ')})" for s, q in _SECTIONS.items()))
