"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
flagged AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r, doc_id
"""

# Words, statistics and frequent lines of the quality rules; limits as in quality_rules.
OP5 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
windows AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
seen AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS again FROM windows WHERE w3 IS NOT NULL),
spread AS (SELECT DISTINCT r, i + j AS i FROM seen, (VALUES (0), (1), (2)) AS d(j) WHERE again),
per_word AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
per_spread AS (SELECT r, count(*) AS n_repeat_words FROM spread GROUP BY r),
lines AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
real AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY r),
norm AS (
  SELECT r, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+'), ' ') AS k FROM real),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
often AS (
  SELECT norm.source, k FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source
  GROUP BY norm.source, k, hosts.n HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.02 * hosts.n),
removed AS (
  SELECT r, sum(n)::BIGINT AS n_removed_words FROM norm JOIN often ON norm.k = often.k AND norm.source IS NOT DISTINCT FROM often.source
  GROUP BY r),
stats AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM docs LEFT JOIN per_word USING (r) LEFT JOIN per_spread USING (r) LEFT JOIN per_line USING (r) LEFT JOIN removed USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - n_removed_words) < 0.3 * n_words AS kept, n_removed_words
FROM failed
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op5_quality_rules": OP5, "op7_exact_dedup": OP7}
