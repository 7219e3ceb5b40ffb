"""SQL for DuckDB of the cleaning queries. It starts from the numbers that a row's cells are made of, not from its text."""

from __future__ import annotations

from tallyhouse.oracle import FACTS, query
from tallyhouse.plans.dirty import CELLS, NUMBERS, TEXT

SPELT = {"div": "//", "text": "VARCHAR", "serial": "(d - DATE '1899-12-30')"}
VALUE = {
    "stat_date": "CASE WHEN n % 97 <> 0 AND n % 101 <> 0 THEN d END", "shop_name": "CASE WHEN n % 13 <> 0 THEN '店' || shop END", "code": "CAST(product AS VARCHAR)", "name": "CASE WHEN n % 89 = 0 THEN '测试品' WHEN n % 83 = 0 THEN '夏季赠品' WHEN n % 3 <> 0 THEN '品' || n % 7 END",
    "category": "CASE WHEN n % 4 <> 0 THEN '类' || product % 5 END", "gmv": "CAST(CASE WHEN n % 67 = 0 THEN NULL WHEN n % 31 = 0 OR n % 29 = 0 THEN 0 ELSE cents / CAST(100 AS DECIMAL(5,2)) END AS DECIMAL(14,2))",
    "qty": "CASE WHEN n % 9 = 0 THEN q + 1 WHEN n % 6 = 0 THEN q WHEN n % 23 = 0 THEN 0 ELSE q END", "refund": "CAST((r3 // 10 + CASE WHEN r3 % 10 > 5 OR r3 % 10 = 5 AND r3 // 10 % 2 = 1 THEN 1 ELSE 0 END) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(14,2))",
    "visitors": "CASE WHEN n % 19 <> 0 THEN (1 + q // 10) * 1000 + q END", "buyers": "CASE WHEN n % 21 <> 0 THEN q END", "ad_cost": "CAST(CASE WHEN n % 10 = 0 THEN 0 ELSE (n % 1000 // 100 * 100 + n % 100) * CAST(0.01 AS DECIMAL(4,2)) END AS DECIMAL(14,2))",
}
ROWS = f"""numbered AS (SELECT {', '.join(f'{e} AS {c}' for c, e in NUMBERS.items())} FROM lineitem),
 valued AS (SELECT *, {', '.join(f'{e} AS v_{c}' for c, e in VALUE.items())} FROM numbered),
 judged AS (SELECT *, coalesce(v_shop_name, '__UNKNOWN__') AS shop_code, (n % 97 = 0)::INT + (n % 67 = 0)::INT + (n % 21 = 0)::INT AS n_bad,
   CASE WHEN v_stat_date IS NULL THEN '被过滤：stat_date not_null' WHEN n % 89 = 0 OR n % 83 = 0 THEN '被过滤：product_name not_contains' END AS why FROM valued),
 good AS (SELECT *, row_number() OVER (PARTITION BY d, product, shop_code ORDER BY n) AS nth, row_number() OVER (PARTITION BY d, product, shop_code ORDER BY n DESC) AS from_last, first_value(n) OVER (PARTITION BY d, product, shop_code ORDER BY n) AS first_n FROM judged WHERE n_bad = 0 AND why IS NULL),
 summed AS (SELECT first_n AS row_no, d AS stat_date, shop_code, any_value(v_code) AS platform_product_code, arg_min(v_shop_name, n) FILTER (v_shop_name IS NOT NULL) AS shop_name, arg_min(v_name, n) FILTER (v_name IS NOT NULL) AS product_name, arg_min(v_category, n) FILTER (v_category IS NOT NULL) AS category,
   CAST(sum(v_gmv) AS DECIMAL(14,2)) AS gmv, CAST(sum(v_refund) AS DECIMAL(14,2)) AS refund_amount, CAST(sum(v_qty) AS BIGINT) AS paid_qty, CAST(coalesce(sum(v_visitors), 0) AS BIGINT) AS visitors, CAST(sum(v_buyers) AS BIGINT) AS buyers, CAST(sum(v_ad_cost) AS DECIMAL(14,2)) AS ad_cost
   FROM good GROUP BY first_n, d, shop_code)"""
BAD = """SELECT n AS row_number, 'date_parse_failed' AS error_type, '字段 stat_date 无法解析：not-a-date' AS error_message FROM judged WHERE n % 97 = 0
 UNION ALL SELECT n, 'number_parse_failed', '字段 gmv 无法解析：N/A' FROM judged WHERE n % 67 = 0 UNION ALL SELECT n, 'number_parse_failed', '字段 buyers 无法解析：abc' FROM judged WHERE n % 21 = 0
 UNION ALL SELECT n, 'filtered_out', why FROM judged WHERE n_bad = 0 AND why IS NOT NULL
 UNION ALL SELECT n, 'duplicate_row', '重复行，已按 sum 策略合并（keys=[''stat_date'', ''platform_key'', ''platform_product_code'', ''shop_code'']）' FROM good WHERE nth > 1"""
PARTS = f"""channel(i, platform_key) AS (VALUES (0, 'taobao'), (1, 'doudian'), (2, 'pinduoduo'), (3, 'jd')),
 codes AS (SELECT p_partkey AS k, platform_key, CASE WHEN p_partkey % 3 = 0 THEN 'K' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS platform_product_code, p_name FROM part JOIN channel ON i = p_partkey % 4),
 mapped AS (SELECT k AS id, platform_key, platform_product_code, p_name AS platform_product_name, CASE WHEN k % 14 <> 0 THEN k + 1 END AS sku_id, CASE WHEN k % 14 <> 0 THEN 'manual' ELSE 'unmapped' END AS match_type FROM codes WHERE k % 7 = 0),
 listed AS (SELECT *, id % 11 <> 0 AS active FROM skus),
 exact AS (SELECT k, id FROM codes JOIN listed ON sku_code = platform_product_code AND active),
 matched AS (SELECT codes.platform_key, codes.platform_product_code, coalesce(mapped.sku_id, exact.id) AS sku_id, CASE WHEN mapped.sku_id IS NOT NULL THEN 'mapping' WHEN exact.id IS NOT NULL THEN 'exact' ELSE 'unmapped' END AS match_type FROM codes LEFT JOIN mapped USING (platform_key, platform_product_code) LEFT JOIN exact USING (k))"""


def cleaning(body: str) -> str:
    return f"WITH {ROWS} {body}"


def identity(body: str) -> str:
    return f"WITH {FACTS}, {PARTS} {body}"


def kept(which: str) -> str:
    return cleaning(f"SELECT n AS row_no, d AS stat_date, shop_code, v_code AS platform_product_code, v_name AS product_name, v_gmv AS gmv, v_qty AS paid_qty, CAST(v_visitors AS BIGINT) AS visitors FROM good WHERE {which} = 1")


def _normal(name: str) -> str:
    """normal_name() of names without brackets."""
    return f"trim(regexp_replace(regexp_replace(lower({name}), 'kg|ml', '', 'g'), '\\s+', ' ', 'g'))"


def _tokens(name: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({name}, ' '), lambda w: w <> '')), ' ')"


X = {
    "not_null": "x <> ''", "is_null": "coalesce(x, '') = ''", "numeric": "TRY_CAST(x AS DOUBLE) IS NOT NULL", "in": "x IN ('5', 'ab3', '')", "not_in": "x IS NULL OR x NOT IN ('5', 'ab3', '')", "contains": "contains(x, 'b1') OR contains(x, '5')",
    "not_contains": "x IS NULL OR NOT (contains(x, 'b1') OR contains(x, '5'))", "gt": "TRY_CAST(x AS DOUBLE) > 9", "gte": "TRY_CAST(x AS DOUBLE) >= 9", "lt": "TRY_CAST(x AS DOUBLE) < 5", "lte": "TRY_CAST(x AS DOUBLE) <= 5", "eq": "TRY_CAST(x AS DOUBLE) = 7", "neq": "coalesce(TRY_CAST(x AS DOUBLE) <> 7, true)",
}
SQL = {
    "normalise_facts": cleaning("SELECT row_no, stat_date, 'taobao' AS platform_key, shop_code, shop_name, platform_product_code, product_name, category, CAST(NULL AS BIGINT) AS order_qty, paid_qty, gmv, refund_amount, CAST(gmv - refund_amount AS DECIMAL(14,2)) AS net_amount, visitors, buyers, ad_cost FROM summed"),
    "normalise_errors": cleaning(BAD),
    "normalise_stats": cleaning(f"SELECT (SELECT count(*) FROM judged) AS total, (SELECT count(*) FROM summed) AS valid, count(*) FILTER (error_type = 'filtered_out') AS filtered, count(*) FILTER (error_type = 'duplicate_row') AS duplicated, count(*) FILTER (error_type LIKE '%parse_failed') AS failed FROM ({BAD})"),
    "raw_json_snapshot": cleaning("SELECT n AS row_no, CAST(json_object(" + ", ".join(f"'{h}', {e.format(**SPELT)}" for h, e in CELLS.items()) + ") AS VARCHAR) AS raw_row_json FROM good WHERE nth = 1"),
    "dedup_sum": cleaning("SELECT row_no, stat_date, shop_code, platform_product_code, product_name, gmv, paid_qty, visitors FROM summed"),
    "dedup_first": kept("nth"), "dedup_last": kept("from_last"),
    "dedup_group_sizes": cleaning("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM good GROUP BY first_n, d, shop_code) GROUP BY size"),
    **{f"filter_{op}": cleaning(f"SELECT n, x FROM (SELECT n, {TEXT.format(**SPELT)} AS x FROM numbered) WHERE {c}") for op, c in X.items()},
    "money_cast": cleaning("SELECT n AS row_no, v_gmv AS gmv, n % 67 = 0 AS gmv_failed, v_refund AS refund, CAST(CASE WHEN r3 % 1000 % 1000 >= 0 THEN (r3 // 1000 + CASE WHEN r3 % 1000 > 500 OR r3 % 1000 = 500 AND r3 // 1000 % 2 = 1 THEN 1 ELSE 0 END) END * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(14,2)) AS refund_fen FROM valued"),
    "integer_half_up": cleaning("SELECT n AS row_no, CAST(v_qty AS BIGINT) AS qty, CAST(CASE WHEN n % 9 = 0 THEN -(q + 1) WHEN n % 6 <> 0 AND n % 23 = 0 THEN NULL ELSE -q END AS BIGINT) AS negative FROM valued"),
    "loose_numbers": cleaning("SELECT n AS row_no, CASE WHEN n % 67 <> 0 AND n % 31 <> 0 AND n % 29 <> 0 THEN v_gmv END AS gmv, n % 67 = 0 AS failed, CAST(v_visitors AS BIGINT) AS visitors FROM valued"),
    "date_multi_format": cleaning("SELECT n AS row_no, v_stat_date AS stat_date, n % 97 = 0 AS failed FROM valued"),
    "excel_serial": cleaning("SELECT n AS row_no, d AS stat_date FROM numbered"),
    "shop_fallback": cleaning("SELECT shop_code, count(*) AS n, count(v_shop_name) AS named FROM judged GROUP BY shop_code"),
    "string_clean": cleaning("SELECT n AS row_no, v_code AS code, v_category AS category FROM valued"),
    "name_normalize": "SELECT p_partkey, trim(regexp_replace(lower(p_name) || ' ' || lower(p_name), '\\s+', ' ', 'g')) AS name FROM part",
    "net_formula": query("SELECT upload_id, CAST(row_no AS BIGINT) AS row_no, CAST(gmv - CASE WHEN row_no <> 3 THEN refund_amount ELSE 0 END - 2 * ad_cost AS DECIMAL(14,2)) AS net, round(CAST(gmv AS DOUBLE) / nullif(paid_qty - 1, 0), 6) AS unit FROM facts"),
    "sku_match": identity("SELECT * FROM matched"),
    "exact_sku_match": identity("SELECT platform_key, platform_product_code, sku_id FROM matched WHERE match_type = 'exact'"),
    "mapping_lookup": identity("SELECT platform_key, platform_product_code, sku_id FROM matched WHERE match_type = 'mapping'"),
    "mapping_stats": identity("SELECT platform_key, match_type, count(*) AS codes FROM matched GROUP BY ALL"),
    "mapping_upsert": identity("""SELECT platform_key, platform_product_code, CASE WHEN fresh AND x.id % 2 = 0 THEN 'new' WHEN m.id IS NOT NULL THEN platform_product_name WHEN fresh THEN platform_product_name END AS platform_product_name,
 CASE WHEN fresh AND (x.id IS NOT NULL OR m.sku_id IS NULL) THEN x.id ELSE m.sku_id END AS sku_id, CASE WHEN fresh AND (x.id IS NOT NULL OR m.sku_id IS NULL) THEN CASE WHEN x.id IS NULL THEN 'unmapped' ELSE 'exact' END ELSE m.match_type END AS match_type
 FROM (SELECT *, platform_key <> 'jd' AS fresh FROM codes) LEFT JOIN exact x USING (k) LEFT JOIN mapped m USING (platform_key, platform_product_code) WHERE fresh OR m.id IS NOT NULL"""),
    "upsert_ids": "SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT CAST((SELECT max(p_partkey) FROM part WHERE p_partkey % 7 = 0) + row_number() OVER () AS BIGINT) FROM part WHERE p_partkey % 7 <> 0",
    "mapping_listing": identity("SELECT m.platform_key, m.platform_product_code, m.sku_id, s.sku_code, s.name AS sku_name FROM mapped m LEFT JOIN skus s ON m.sku_id = s.id"),
    "missing_skus": identity("SELECT DISTINCT sku_id FROM mapped WHERE sku_id IS NOT NULL AND sku_id NOT IN (SELECT id FROM skus)"),
    "like_search": query("SELECT id, sku_code, name FROM skus WHERE name ILIKE '%E%1%' OR sku_code ILIKE '%k_7%'"),
    "page_after": query("SELECT id, sku_code, status FROM (SELECT id, sku_code, CASE WHEN id % 13 <> 0 THEN CASE WHEN id % 11 = 0 THEN 'inactive' ELSE 'active' END END AS status FROM skus) WHERE status < 'inactive' OR status IS NULL OR status = 'inactive' AND id > 44 ORDER BY status DESC NULLS LAST, id LIMIT 60"),
    "page_listing": query("SELECT id, sku_code FROM skus WHERE id % 11 <> 0 ORDER BY id LIMIT 20 OFFSET 40"),
    "fuzzy_candidates": f"""WITH {FACTS}, asked AS (SELECT p_partkey AS product, {_normal("p_name || ' ' || right(p_brand, 2)")} AS t, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS category FROM part WHERE p_partkey % 5 = 0),
 live AS (SELECT id, sku_code, name, category, {_normal('name')} AS s FROM skus WHERE id % 11 <> 0), sizes AS (SELECT category, count(*) AS n FROM live GROUP BY 1),
 spelt AS (SELECT t, s, string_split({_tokens('t')}, '') AS x, string_split({_tokens('s')}, '') AS y FROM (SELECT DISTINCT t FROM asked), (SELECT DISTINCT s FROM live)),
 masked AS (SELECT *, (CAST(1 AS BIGINT) << len(x)) - 1 AS ones, list_transform(y, lambda c: CAST(list_sum(list_transform(range(len(x)), lambda i: CASE WHEN x[i + 1] = c THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS masks FROM spelt),
 scored AS (SELECT t, s, CAST(200 AS DOUBLE) * (len(x) - bit_count(list_reduce(list_prepend(ones, masks), lambda v, m: ((v + (v & m)) | (v & ~m)) & ones))) / (len(x) + len(y)) AS score FROM masked),
 found AS (SELECT product, live.id AS sku_id, sku_code, name AS sku_name, score, row_number() OVER (PARTITION BY product ORDER BY score DESC, live.id) AS rank
  FROM asked LEFT JOIN sizes USING (category) JOIN scored USING (t) JOIN live USING (s) WHERE score >= 75 AND (coalesce(n, 0) < 5 OR live.category = asked.category))
 SELECT *, CASE WHEN score >= 90 THEN 'high' ELSE 'medium' END AS band FROM found WHERE rank <= 3""",
}
