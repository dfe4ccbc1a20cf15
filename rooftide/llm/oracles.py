"""DuckDB SQL for the contract queries that SQL can express."""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src = '', src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src)
), leveled AS (
  SELECT *, ((SELECT sum(source_size)::BIGINT FROM sources) * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / sum(weight) OVER (ORDER BY source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT src, source_size,
         least(source_size * 2.0::DOUBLE, coalesce((SELECT max(level) FROM leveled WHERE level * weight <= source_size * 2.0::DOUBLE), 0.0::DOUBLE) * weight)::DOUBLE AS target
  FROM leveled
), ranked AS (
  SELECT s.*, source_size, target, row_number() OVER (PARTITION BY s.src ORDER BY size, doc_id NULLS FIRST) AS rank,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || s.src), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN targets t ON s.src = t.src
)
SELECT doc_id, size, source_size, target,
       (least(floor(rank * rate + start) - floor((rank - 1) * rate + start), 2)::BIGINT * size)::BIGINT AS taken
FROM ranked
"""

OP7 = r"""
WITH lines AS (
  SELECT doc_id, pos, line, length(key) >= 10 AS long_enough, key
  FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (
      SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
  )
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE long_enough GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.long_enough AND l.doc_id > f.first, false) AS dropped
  FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = r"""
WITH rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parsed AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), won AS (
  SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY n
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '(^|[^a-z0-9])(casino|jackpot|malware|pills|poker|porn|spam|viagra|warez|xxx)([^a-z0-9]|$)')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN won USING (n)
"""

ORACLES = {"op5_source_mix": OP5, "op7_line_dedup": OP7, "op8_url_filter": OP8}
