"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = """
WITH sized AS (
  SELECT doc_id, source, coalesce(source, '') AS src, source IS NULL AS src_null,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '/' || coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0))) AS key
  FROM documents),
sizes AS (
  SELECT src, src_null, CAST(sum(size) AS BIGINT) AS full_size,
    (row_number() OVER (ORDER BY src_null, src) - 1) % 3 AS k, row_number() OVER (ORDER BY src_null, src) AS rank
  FROM sized GROUP BY src, src_null),
weighed AS (
  SELECT *, CASE k WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, CASE k WHEN 0 THEN 0.5e0 WHEN 1 THEN 0e0 ELSE -0.5e0 END AS slope FROM sizes),
levels AS (
  SELECT *, CAST(full_size AS DOUBLE) * 3 / weight AS ratio,
    CAST((sum(full_size) OVER () - 3 * coalesce(sum(full_size) OVER (ORDER BY full_size * 3e0 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
    / sum(weight) OVER (ORDER BY full_size * 3e0 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT src, src_null, full_size, slope,
    least(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), full_size * 3e0) AS target
  FROM levels),
placed AS (
  SELECT s.*, g.full_size, g.slope, g.target,
    CASE WHEN full_size > 0 THEN CAST(floor(target / full_size) AS BIGINT) ELSE 0 END AS full_passes,
    coalesce(sum(size) OVER (PARTITION BY s.src, s.src_null ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sized s JOIN goals g ON s.src = g.src AND s.src_null = g.src_null),
shares AS (
  SELECT *, greatest(0, least(size, CAST(floor(target + 0.5e0) AS BIGINT) - full_passes * full_size - begins)) AS part, begins / target AS u, 1e0 - slope AS linear
  FROM placed)
SELECT doc_id, source, size, full_size AS source_size, target,
  CAST(full_passes * size + part AS BIGINT) AS taken,
  CAST(CASE WHEN full_passes * size + part > 0 THEN full_passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS passes,
  CASE WHEN full_passes * size + part > 0 THEN 2 * u / (linear + sqrt(linear * linear + 4 * slope * u)) END AS position
FROM shares
"""


_WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, source IS NULL AS hostless, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
wc AS (SELECT r, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY r),
tri AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM hit) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (
  SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
    substr(md5(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[^a-z0\\x{{80}}-\\x{{10FFFF}}]', '', 'g')), 1, 16) AS h
  FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
dl AS (SELECT r, h, sum(n) AS n FROM lw GROUP BY r, h),
wh AS (SELECT r, string_agg(h, ',' ORDER BY h) AS whole FROM dl GROUP BY r),
hosts AS (SELECT host, hostless, count(DISTINCT coalesce(whole, '')) AS documents FROM d LEFT JOIN wh USING (r) GROUP BY host, hostless),
held AS (
  SELECT host, hostless, h, count(DISTINCT whole) AS held_by
  FROM dl JOIN wh USING (r) JOIN d USING (r)
  GROUP BY host, hostless, h),
freq AS (SELECT host, hostless, h FROM held JOIN hosts USING (host, hostless) WHERE held_by > 10 AND held_by > documents * 0.01e0),
gone AS (SELECT r, sum(n) AS n FROM dl JOIN d USING (r) JOIN freq USING (host, hostless, h) GROUP BY r),
base AS (
  SELECT doc_id, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_words, CAST(coalesce(wc.c, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS frequent_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - frequent_words >= n_words * 0.3e0 AS kept FROM failed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY, "op8_source_mixing": MIXING}
