"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyhouse.llm import queries_free as free
from tallyhouse.llm import queries_native as native

QUERIES = {
    f.__name__: f
    for f in (
        native.op1_personal_data,
        free.op2_anisotropic_search,
        native.op3_url_redirect_filter,
        native.op4_quality_outliers,
        free.op5_feistel_shards,
        free.op6_toxicity_ftrl,
        free.op7_source_mixture,
        free.op8_license_diagonals,
        free.op9_simhash_covering,
        free.op10_vector_packing,
        free.op11_weighted_sampling,
        free.op12_fill_in_middle,
        free.op13_periodic_runs,
    )
}

#: Targets by levels: sources in the order of cap over weight; the first that the level of the rest leaves under its cap sets it.
MIXTURE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT *, list_extract(CAST([3, 1, 2] AS DOUBLE[]), CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT min(level) FROM r WHERE weight * level < cap AND cap / weight = (SELECT min(cap / weight) FROM r WHERE weight * level < cap)), 0)) AS target FROM s),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, budget - passes * source_size - before)) AS BIGINT) AS taken FROM p
"""
#: Links of pages as urls, nodes as host, path and query, and blocks carried along links in both directions until nothing is new.
URLS = r"""
WITH RECURSIVE rules(verdict, host, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme FROM pages),
tags AS (SELECT p.*, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
targets AS (SELECT *, replace(regexp_extract(tag, '(?i)(?:\bhref\s*=\s*|;\s*url\s*=\s*)["'']?([^"''>\s]+)', 1), '&amp;', '&') AS link FROM tags
  WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b')),
absolute AS (SELECT url AS source, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link
    WHEN starts_with(link, '?') THEN scheme || '://' || host || path || link WHEN starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE scheme || '://' || host || regexp_replace(CASE path WHEN '' THEN '/' ELSE path END, '[^/]*$', '') || link END AS target FROM targets WHERE link <> ''),
urls AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
    regexp_extract(url, '^[^#?]*(\?[^#]*)', 1) AS query FROM (SELECT url FROM pages UNION SELECT target FROM absolute) WHERE contains(url, '://')),
nodes AS (SELECT url, host || path || query AS node, regexp_extract(host || path || query, '^([^/?]*)', 1) AS host, regexp_extract(host || path || query, '^[^/?]*([^?]*)', 1) AS path FROM urls),
edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM absolute JOIN nodes a ON a.url = source JOIN nodes b ON b.url = target),
fits AS (SELECT host, path, arg_max({'rule': name, 'verdict': verdict}, (length(name), verdict = 'allow', name)) AS fit
  FROM (SELECT w.host, w.path, r.host || r.start AS name, verdict FROM (SELECT host, path FROM p UNION SELECT host, path FROM nodes) w JOIN rules r ON (w.host = r.host OR ends_with(w.host, '.' || r.host)) AND starts_with(w.path, r.start)) GROUP BY ALL),
blocked(node) AS (SELECT node FROM nodes JOIN fits USING (host, path) WHERE fit.verdict = 'block' AND node IN (SELECT a FROM edges UNION ALL SELECT b FROM edges)
  UNION SELECT e.v FROM blocked JOIN (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges) e ON e.u = blocked.node)
SELECT page_id, p.host, p.path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN nodes.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path LEFT JOIN nodes ON nodes.url = p.url
"""
#: Units listed one by one, cuts by slices of the list, and the text rebuilt by where the marks stand.
MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, strpos(output, '<P>') AS x, strpos(output, '<S>') AS y, strpos(output, '<M>') AS z FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, y - 4) || substr(output, z + 3) || substr(output, y + 3, z - y - 3) ELSE substr(output, x + 3, z - x - 3) || substr(output, z + 3) || substr(output, 4, x - 4) END) AS restored_sha256 FROM r
"""
ORACLE_SQL: dict[str, str] = {"op12_fill_in_middle": MIDDLE, "op3_url_redirect_filter": URLS, "op7_source_mixture": MIXTURE}
