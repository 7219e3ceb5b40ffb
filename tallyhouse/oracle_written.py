"""SQL for DuckDB of the queries through files and table writes. It starts from the values, not from files."""

from __future__ import annotations

from tallyhouse.oracle import FACTS


def _rewritten(touched: str, value: str) -> str:
    return f"WITH {FACTS}, touched AS (SELECT DISTINCT upload_id FROM facts WHERE {touched}) SELECT upload_id, row_no, platform_key, platform_product_code, CASE WHEN {touched} THEN {value} ELSE sku_id END AS sku_id FROM facts SEMI JOIN touched USING (upload_id)"


_PART = "CAST(platform_product_code AS BIGINT)"
SQL = {
    "channel_files": f"""WITH {FACTS} SELECT platform_key, stat_date, count(DISTINCT (upload_id // 8000, platform_product_code, shop_code)) AS n_facts, CAST(sum(gmv) AS DECIMAL(20,2)) AS gmv, CAST(sum(refund_amount) AS DECIMAL(20,2)) AS refund_amount,
 CAST(sum(ad_cost) AS DECIMAL(20,2)) AS ad_cost, CAST(sum(paid_qty) AS BIGINT) AS paid_qty, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(buyers) AS BIGINT) AS buyers FROM facts WHERE (upload_id + row_no) % 97 <> 0 GROUP BY ALL""",
    "detail_files": f"""WITH {FACTS} SELECT platform_key, stat_date, CAST(sum(gmv) AS DECIMAL(20,2)) AS gmv, CAST(sum(refund_amount) AS DECIMAL(20,2)) AS refund_amount,
 CAST(sum(ad_cost) AS DECIMAL(20,2)) AS ad_cost, CAST(sum(paid_qty) AS BIGINT) AS paid_qty, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(buyers) AS BIGINT) AS buyers FROM facts GROUP BY ALL""",
    "sku_backfill": _rewritten(f"platform_key = 'taobao' AND {_PART} % 30 = 0", f"{_PART} + 1"),
    "sku_cleared": _rewritten(f"platform_key = 'jd' AND {_PART} % 20 = 7", "NULL"),
}
