"""The corpus queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w
      FROM d GROUP BY source),
v AS (SELECT *, 2.0 * source_size AS lim, 2.0 * source_size / w AS lim_at, 1.5 * sum(source_size) OVER () AS wanted FROM s),
lv AS (SELECT *, (wanted - coalesce(sum(lim) OVER (ORDER BY lim_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY lim_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT source, source_size,
             least(lim, w * coalesce((SELECT level FROM lv WHERE level <= lim_at ORDER BY lim_at, source NULLS LAST LIMIT 1), 'inf'::DOUBLE))::DOUBLE AS target
      FROM lv),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
o AS (SELECT *, target - whole * source_size AS open FROM p),
cl AS (SELECT d.source, length(bin(d.size)) AS k, any_value(o.open) AS open, sum(d.size) AS words FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source WHERE o.open > 0 GROUP BY ALL),
cw AS (SELECT *, sqrt(pow(2.0::DOUBLE, k)) AS mass, (open - coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / nullif(sum(sqrt(pow(2.0::DOUBLE, k)) * words) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS level FROM cl),
cs AS (SELECT source, arg_max(level, k) FILTER (WHERE level * mass <= 1) AS level FROM cw GROUP BY source),
q AS (SELECT d.*, least(1.0::DOUBLE, level * sqrt(pow(2.0::DOUBLE, length(bin(size))))) AS rate FROM d LEFT JOIN cs ON d.source IS NOT DISTINCT FROM cs.source),
r AS (SELECT q.doc_id, q.size, o.source_size, o.target, o.whole, o.open, q.source,
             sum(q.size) OVER (PARTITION BY q.source ORDER BY (u / (1 - u)) * ((1 - rate) / rate), q.doc_id, q.size) AS upto FROM q JOIN o ON q.source IS NOT DISTINCT FROM o.source),
b AS (SELECT source, upto AS nearest FROM (
        SELECT source, upto, row_number() OVER (PARTITION BY source ORDER BY abs(upto - open), upto) AS n
        FROM (SELECT source, upto, open FROM r UNION SELECT source, 0, open FROM r)) WHERE n = 1)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.whole + CASE WHEN r.upto <= b.nearest AND r.open > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source""",
    "op10_warc_revisits": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS g FROM pages),
o AS (SELECT g, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY g, n)
SELECT page_id, p.n AS payload_bytes, p.g AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN o ON p.g = o.g AND p.n = o.n""",
    "op8_impact_topk": """
WITH v AS (SELECT vec_id, max([floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_url_filters": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages),
r(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, arg_max(h || s, length(h || s)) AS rule, coalesce(arg_max(v, length(h || s)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY n, page_id, host, path""",
}
