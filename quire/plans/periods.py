"""Problem 2: periods and gaps of every book."""

from __future__ import annotations

from quire.operators.intervals import book_periods
from quire.tables import table

QUERIES = {"p2_found": lambda s, d: book_periods(table(s, d, "nodes"), table(s, d, "sections"), table(s, d, "books"))}

SQL = {
    "p2_found": """
WITH b AS (SELECT DISTINCT book_id, total_chars, page_count FROM books WHERE total_chars IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, node_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM nodes) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM sections) WHERE rn = 1),
r AS (
  SELECT 'leaf' AS k, n.book_id, n.start_off AS lo, n.end_off AS hi, CAST(0 AS BIGINT) AS a, b.total_chars AS z FROM n JOIN b USING (book_id) WHERE n.is_leaf AND n.start_off < n.end_off
  UNION ALL
  SELECT 'page', s.book_id, CAST(s.start_page AS BIGINT), CAST(s.end_page + 1 AS BIGINT), CAST(1 AS BIGINT), CAST(b.page_count + 1 AS BIGINT) FROM s JOIN b USING (book_id) WHERE s.start_page <= s.end_page),
m AS (SELECT *, max(hi) OVER (PARTITION BY k, book_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY k, book_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT k, book_id, g, min(lo) AS lo, max(hi) AS hi, min(a) AS a, min(z) AS z FROM i GROUP BY k, book_id, g),
e AS (
  SELECT k, book_id, lo, hi, a, z FROM p
  UNION ALL SELECT 'leaf', book_id, NULL, 0, 0, total_chars FROM b
  UNION ALL SELECT 'page', book_id, NULL, 1, 1, page_count + 1 FROM b),
q AS (SELECT k, book_id, greatest(hi, a) AS lo, least(coalesce(lead(lo) OVER (PARTITION BY k, book_id ORDER BY lo NULLS FIRST), z), z) AS hi FROM e)
SELECT book_id, k || '_period' AS kind, lo, CASE WHEN k = 'page' THEN hi - 1 ELSE hi END AS hi FROM p
UNION ALL
SELECT book_id, k || '_gap' AS kind, lo, CASE WHEN k = 'page' THEN hi - 1 ELSE hi END AS hi FROM q WHERE lo < hi""",
}
