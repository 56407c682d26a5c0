"""Queries over positioned text items: every line of a block is laid out as an item of its page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.tables import table

WIDTH, HEIGHT = 600.0, 800.0


def _items(s, d):
    """Lines at 11 points below each other, blocks 30 apart, every third line a little lower, odd blocks in a second column."""
    b = table(s, d, "blocks", "rec_id", "book_id", "page_no", "block_idx", "text", "font_hint").dropDuplicates(["rec_id"]).where("text is not null")
    i = b.select(F.concat_ws("/", "book_id", "page_no").alias("page_id"), "block_idx", F.coalesce("font_hint", F.lit("serif")).alias("font"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    x = F.when(F.col("block_idx") % 2 == 1, 330.0).otherwise(40.0) + F.col("k") % 5
    y = F.col("block_idx") * 30.0 + F.col("k") * 11.0 + F.when(F.col("k") % 3 == 2, 1.5).otherwise(0.0)
    return i.select("page_id", x.alias("x"), y.alias("y"), (F.length("text") * 2.0).alias("width"), F.lit(9.0).alias("height"), "text", "font")


def _flipped(s, d):
    up = _items(s, d).select("page_id", "x", (HEIGHT - F.col("y")).alias("y"), "text", F.lit(HEIGHT).alias("page_height"))
    return L.flipped(up).select("page_id", "x", "y", F.md5("text").alias("text"))


def _classes(s, d):
    return L.banded(L.blocks(_items(s, d), WIDTH), F.substring_index("page_id", "/", 1), HEIGHT)


QUERIES = {
    "items_flipped": _flipped,
    "row_cluster": lambda s, d: L.rows(_items(s, d)).select("page_id", "x", "y", F.md5("text").alias("text"), "row"),
    "column_split": lambda s, d: L.column_split(_items(s, d), WIDTH),
    "layout_blocks": lambda s, d: L.blocks(_items(s, d), WIDTH).select("page_id", "row", "side", F.md5("text").alias("text"), "font", "x", "y", "w", "h"),
    "layout_classes": _classes,
    "book_metadata": lambda s, d: table(s, d, "books", "book_id", "title", "author").select("book_id", L.clean_metadata(F.col("title")).alias("title"), L.clean_metadata(F.col("author")).alias("author")),
}

_I = """i AS (SELECT page_id, CASE WHEN block_idx % 2 = 1 THEN 330.0::DOUBLE ELSE 40.0::DOUBLE END + k % 5 AS x, block_idx * 30.0::DOUBLE + k * 11.0::DOUBLE + CASE WHEN k % 3 = 2 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS y,
  length(text) * 2.0::DOUBLE AS width, 9.0::DOUBLE AS height, text, font FROM (SELECT book_id || '/' || page_no AS page_id, block_idx, coalesce(font_hint, 'serif') AS font, unnest(ls) AS text, unnest(range(0, len(ls))) AS k
  FROM (SELECT DISTINCT rec_id, book_id, page_no, block_idx, font_hint, string_split(text, chr(10)) AS ls FROM blocks WHERE text IS NOT NULL)))"""
_R = f"""RECURSIVE {_I}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, text) AS k FROM i),
f AS (SELECT page_id, k, y AS mean, 1 AS n, 0 AS r FROM o WHERE k = 1 UNION ALL
  SELECT o.page_id, o.k, CASE WHEN abs(o.y - f.mean) <= 0.6 * greatest(o.height, 4) THEN (f.mean * f.n + o.y) / (f.n + 1) ELSE o.y END, CASE WHEN abs(o.y - f.mean) <= 0.6 * greatest(o.height, 4) THEN f.n + 1 ELSE 1 END,
  CASE WHEN abs(o.y - f.mean) <= 0.6 * greatest(o.height, 4) THEN f.r ELSE f.r + 1 END FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1),
rw AS (SELECT o.*, f.r AS row FROM o JOIN f USING (page_id, k))"""
_S = "sp AS (SELECT page_id, arg_max((x + p) / 2, struct_pack(g := x - p, np := -p)) AS split FROM (SELECT page_id, x, lag(x) OVER (PARTITION BY page_id ORDER BY x) AS p, count(*) OVER (PARTITION BY page_id) AS n FROM i) WHERE n >= 20 AND p < 300 AND x > 300 AND x - p > 60 GROUP BY page_id)"
_B = f"""{_R}, {_S}, sd AS (SELECT rw.*, CASE WHEN split IS NOT NULL AND x + width / 2 >= split THEN 1 ELSE 0 END AS side FROM rw LEFT JOIN sp USING (page_id)),
fn AS (SELECT page_id, row, side, font, count(*) AS c, min(struct_pack(y, x)) AS fst FROM sd GROUP BY ALL),
bl AS (SELECT page_id, row, side, regexp_replace(string_agg(text, ' ' ORDER BY x, text), '[ \\t]+', ' ', 'g') AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS w, max(y + height) - min(y) AS h FROM sd GROUP BY ALL),
fo AS (SELECT page_id, row, side, arg_min(font, struct_pack(n := -c, fst, font)) AS font FROM fn GROUP BY ALL)"""
_TRIM = "regexp_replace(regexp_replace({0}, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')"

SQL = {
    "items_flipped": f"WITH {_I} SELECT page_id, x, y, md5(text) AS text FROM i",
    "row_cluster": f"WITH {_R} SELECT page_id, x, y, md5(text) AS text, row FROM rw",
    "column_split": f"WITH {_I}, {_S} SELECT * FROM sp",
    "layout_blocks": f"WITH {_B} SELECT page_id, row, side, md5(text) AS text, font, x, y, w, h FROM bl JOIN fo USING (page_id, row, side)",
    "layout_classes": f"""WITH {_B}, b AS (SELECT page_id, row, side, {_TRIM.format('text')} AS t, split_part(page_id, '/', 1) AS book, y + h / 2 AS mid FROM bl),
pg AS (SELECT book, count(DISTINCT page_id) AS pages FROM b GROUP BY book),
ag AS (SELECT book, t FROM b JOIN pg USING (book) WHERE (mid < 80 OR mid > 720) AND length(t) BETWEEN 1 AND 80 GROUP BY book, t, pages HAVING count(DISTINCT page_id) >= greatest(2, ceil(pages * 0.3)))
SELECT page_id, row, side, CASE WHEN coalesce(b.t, '') = '' THEN 'body' WHEN ag.t IS NOT NULL AND mid < 80 THEN 'header' WHEN ag.t IS NOT NULL AND mid > 720 THEN 'footer'
  WHEN regexp_matches(b.t, '(?i)^([ivxlcdm]+|[0-9]{{1,4}})$') AND length(b.t) <= 6 AND (mid < 80 OR mid > 720) THEN 'folio' WHEN regexp_matches(b.t, '(?i)^(figure|fig\\.|table|plate|diagram|map)\\b') AND length(b.t) < 200 THEN 'caption'
  WHEN mid > 600 AND regexp_matches(b.t, '^[¹²³⁰⁴-⁹*†‡§]|^[0-9]{{1,3}}[.)][ \\t]+[^ \\t\\n]') THEN 'footnote' ELSE 'body' END AS kind FROM b LEFT JOIN ag ON ag.book = b.book AND ag.t = b.t""",
    "book_metadata": f"SELECT book_id, nullif({_TRIM.format('title')}, '') AS title, nullif({_TRIM.format('author')}, '') AS author FROM books",
}
