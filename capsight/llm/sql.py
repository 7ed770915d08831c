"""DuckDB SQL of the corpus queries that SQL can state."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Exact: every pair that shares a shingle is counted. Lower-casing touches
# A-Z only, so other letters are kept by translate.
NEAR_GROUPS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz')) AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1),
              lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, component_id,
       coalesce(s.doc_id = component_id, false) AS kept
FROM s LEFT JOIN roots ON s.doc_id = roots.doc_id
"""

_STOP = """the of and to a in is it that for was on are as with be by this
der die das und ist nicht ein eine von mit den zu im auf
le la les de des et est un une que dans pour qui pas
el los las y en es por con una del se no""".split()

QUALITY_RULES = f"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda x: list_contains({_STOP!r}, trim(x, '.,;:?')))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN p ON w.k = p.k),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.25
         AND n_stop_words / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 1.5 AS kept,
       n_lines, n_stop_words
FROM f
"""

# The level of the uncapped: sources in the order of the level at which they
# reach their cap; the first k are capped for the smallest k whose level does
# not lift source k + 1 above its cap.
SOURCE_MIXING = f"""
WITH d AS (SELECT doc_id, source, text, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k,
         1.5 * sum(source_size) OVER () AS total FROM s),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS taken, sum(w) OVER rest AS free
  FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT min_by((total - taken) / free, k) AS level
      FROM c WHERE w * ((total - taken) / free) <= 2 * source_size),
t AS (
  SELECT source, source_size,
         CAST(least(w * coalesce((SELECT level FROM l), 0), 2 * source_size) AS DOUBLE) AS target FROM s),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT)
           / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CAST(draw < rate - floor(rate) AS INT)) AS BIGINT) AS taken,
       CAST(floor(rate) + CAST(draw < rate - floor(rate) AS INT) AS BIGINT) AS copies
FROM r
"""
