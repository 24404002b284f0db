"""DuckDB SQL of the mixing query."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, ([3, 1, 2])[1 + place % 3] AS weight, 2 * source_size AS cap FROM p),
c AS (
  SELECT *, sum(cap) OVER o AS cap_through, sum(weight) OVER o AS weight_through,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (
  SELECT *, ((all_size * 150)::BIGINT / 100 - (cap_through - cap)::BIGINT) / (all_weight - (weight_through - weight))::BIGINT AS level FROM c),
f AS (SELECT arg_min(level, weight_through) AS final FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, place, source_size, least(cap::DOUBLE, coalesce(final * weight, cap::DOUBLE)) AS target FROM l, f),
v AS (SELECT *, greatest(ceil(whole / 200000)::BIGINT, 1) AS tokens FROM (SELECT *, sum(target) OVER () AS whole FROM t) WHERE whole > 0),
z AS (SELECT *, tokens > 1 AND target < tokens * 256 AS fine FROM v),
u AS (SELECT *, sum(CASE WHEN fine THEN 0 ELSE target END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM z),
y AS (SELECT *, ceil(CASE WHEN total > 0 THEN total ELSE whole END / tokens)::BIGINT AS slots FROM (SELECT *, max(upto) OVER () AS total FROM u)),
a AS (
  SELECT place, coalesce(lag(high) OVER (ORDER BY place), 0) AS low, high, tokens, slots
  FROM (SELECT *, floor(upto / total * 4294967296)::BIGINT AS high FROM y WHERE total > 0)),
k AS (
  SELECT place, count(*) * any_value(tokens) AS reach
  FROM a JOIN (SELECT range AS slot, (range * 2654435769) % 4294967296 AS point FROM range(200000)) r
    ON point >= low AND point < high AND slot < slots GROUP BY 1
  UNION ALL
  SELECT place, (round(target / ceil(target / 256.0)) * ceil(target / 256.0))::BIGINT FROM y WHERE fine AND target > 0),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.reach, 0) AS reach,
    coalesce(sum(d.size) OVER (PARTITION BY t.place ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.place = t.place)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - source_size)))::BIGINT AS taken
FROM x"""
