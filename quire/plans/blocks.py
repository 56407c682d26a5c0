"""Queries over blocks, pages and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import structure as S
from quire.operators.intervals import latest
from quire.session import checkpointed
from quire.tables import table

COLS = ("rec_id", "book_id", "page_no", "block_idx", "text", "classification", "spine_item_id", "font_hint")


def _b(s, d):
    return B.records(table(s, d, "blocks", *COLS))


def _bounds(s, d, kind=None):
    x = latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["start_page", "title", "source"]).where("start_page is not null")
    x = x.where(F.col("source").isin(*kind)) if kind else x
    return x.select("book_id", F.col("start_page").alias("page_no"), F.coalesce("title", F.lit("")).alias("title"))


def _sides(s, d):
    one = _bounds(s, d, ["outline", "spine"]).select("book_id", "page_no").distinct()
    return one, _bounds(s, d, ["llm-detected"]).select("book_id", "page_no").distinct()


def _checked(s, d, size):
    return S.boundary_crosscheck(*_sides(s, d), S.page_windows(_b(s, d), size))


def _ranked(s, d):
    x = latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["start_page", "title", "source"])
    return x.select("book_id", F.col("start_page").alias("page_no"), F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("source").isin("outline", "spine"), 0).otherwise(1).alias("rank"))


def _latest_sections(s, d):
    return latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["rec_id", "ord", "title", "start_page", "end_page", "confidence"])


def _split(s, d):
    x = _latest_sections(s, d).select("book_id", "rec_id", "ord", F.coalesce("title", F.lit("")).alias("title"), "start_page", "end_page", "confidence")
    cuts = x.where("rec_id % 3 = 0").select("rec_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("block_no")).withColumn("title", F.concat(F.lit("Part "), F.col("block_no").cast("string")))
    return S.split_at(_b(s, d), x, cuts)


def _outline(s, d):
    x = latest(table(s, d, "nodes"), ["book_id", "node_id"], ["stored_at", "rec_id"], ["parent_id", "ord", "title", "start_page"])
    return S.flattened(checkpointed(x))


QUERIES = {
    "header_footer_texts": lambda s, d: B.repeated_edges(_b(s, d)),
    "classify_blocks": lambda s, d: B.classified(_b(s, d), B.repeated_edges(_b(s, d))),
    "verse_runs": lambda s, d: B.verse_runs(_b(s, d)),
    "cast_runs": lambda s, d: B.cast_runs(_b(s, d)),
    "protected_blocks": lambda s, d: B.protected(_b(s, d)),
    "front_back_matter": lambda s, d: B.front_back_matter(_b(s, d)),
    "page_texts": lambda s, d: B.page_texts(_b(s, d)).select("book_id", "page_no", F.md5("text").alias("text"), F.length("text").alias("chars")),
    "no_text_layer": lambda s, d: _b(s, d).groupBy("book_id").agg(F.countDistinct("page_no").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select("book_id", "pages", "chars", ((F.col("pages") > 5) & (F.col("chars") < 100)).alias("no_text")),
    "page_index": lambda s, d: B.page_index(_b(s, d)),
    "offset_to_page": lambda s, d: B.offset_pages(table(s, d, "nodes", "rec_id", "book_id", "start_off").distinct(), B.page_index(_b(s, d)), ["rec_id"], "start_off"),
    "page_windows": lambda s, d: S.page_windows(_b(s, d), 10),
    "sample_windows": lambda s, d: S.sample_windows(S.page_windows(_b(s, d), 5), 0.4),
    "window_text": lambda s, d: S.window_texts(_b(s, d), 10).select("book_id", "win", F.md5("text").alias("text"), F.length("text").alias("chars")),
    "boundary_crosscheck": lambda s, d: _checked(s, d, 50),
    "boundary_crosscheck_10": lambda s, d: _checked(s, d, 10),
    "disagreement": lambda s, d: S.disagreement(_checked(s, d, 10)),
    "mean_confidence": lambda s, d: S.mean_confidence(_latest_sections(s, d)).select("book_id", F.round("confidence", 9).alias("confidence"), "low"),
    "dedupe_ranked": lambda s, d: S.dedupe_boundaries(_ranked(s, d)),
    "split_at_cuts": _split,
    "flatten_outline": _outline,
    "dedupe_boundaries": lambda s, d: S.dedupe_boundaries(_bounds(s, d)),
    "sections": lambda s, d: S.sections_from(S.with_opening(S.dedupe_boundaries(_bounds(s, d))), _b(s, d)),
    "spine_sections": lambda s, d: S.spine_sections(_b(s, d)),
    "slice_preamble": lambda s, d: B.page_index(S.slice_preamble(_b(s, d), 3)),
    "split_sections": lambda s, d: S.oversized_cuts(_b(s, d), latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["rec_id", "start_page", "end_page"]), 3000),
}

_T = "regexp_replace(regexp_replace({0}, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')"
_TT = _T.format("text")
_BL = "b AS (SELECT DISTINCT rec_id, book_id, page_no, block_idx, text, classification, spine_item_id, font_hint FROM blocks)"
_EDGE = "e AS (SELECT book_id, page_no, min(block_idx) AS lo, max(block_idx) AS hi FROM b GROUP BY ALL)"
_REP = f"""rep AS (SELECT t.book_id, t.text, t.pages FROM (SELECT book_id, text, count(*) AS pages FROM (SELECT DISTINCT b.book_id, b.page_no, {_T.format('b.text')} AS text FROM b JOIN e USING (book_id, page_no) WHERE block_idx = lo OR block_idx = hi) WHERE length(text) BETWEEN 1 AND 80 GROUP BY ALL) t
JOIN (SELECT book_id, count(*) AS n FROM e GROUP BY ALL) p USING (book_id) WHERE t.pages >= greatest(2, ceil(p.n * 0.3)))"""
_SHORT = f"coalesce(classification = 'body' AND length({_TT}) BETWEEN 1 AND 59 AND NOT regexp_matches({_TT}, '[.!?…)\"”''’\\]][ \\t\\n\\r\\f\\v]*$'), false)"


def _verse(least: int) -> str:
    return f"""vl AS (SELECT book_id, page_no, block_idx, {_SHORT} AS line FROM b),
vr AS (SELECT *, sum(CASE WHEN line THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, page_no ORDER BY block_idx) AS run FROM vl),
v AS (SELECT book_id, page_no, min(block_idx) AS lo, max(block_idx) AS hi, count(*) AS lines FROM vr WHERE line GROUP BY book_id, page_no, run HAVING count(*) >= {least})"""


_CASTRE = "'(?i)^(dramatis personae|cast of characters|cast|characters|personae)\\b'"


def _castsql(src: str) -> str:
    """Needs ``_verse(3)`` before it."""
    return f"""cs AS (SELECT book_id, page_no, block_idx, regexp_matches(coalesce({_TT}, ''), {_CASTRE}) AS head, coalesce(classification, '') <> 'body' OR coalesce({_TT}, '') = '' OR length({_TT}) > 100
  OR EXISTS (SELECT 1 FROM v WHERE v.book_id = x.book_id AND v.page_no = x.page_no AND x.block_idx BETWEEN v.lo AND v.hi) AS stop FROM {src} x),
cx AS (SELECT *, min(CASE WHEN stop THEN block_idx END) OVER w AS st, max(block_idx) OVER w AS en FROM cs WINDOW w AS (PARTITION BY book_id, page_no ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT book_id, page_no, block_idx AS lo, coalesce(st - 1, en, block_idx) AS hi FROM cx WHERE head AND coalesce(st - 1, en, block_idx) > block_idx)"""


def _mattersql(src: str) -> str:
    case = lambda side: "CASE " + " ".join("WHEN regexp_matches(t, '(?i)^(" + p.replace("'", "''") + f")\\b') THEN '{i:02d}{k}'" for i, (sd, k, p) in enumerate(B.MATTER) if sd == side) + " END"
    return f"""c AS (SELECT * FROM (SELECT *, {_TT} AS t, row_number() OVER (PARTITION BY book_id, page_no ORDER BY block_idx) AS k FROM {src}) WHERE k <= 4 AND coalesce(classification, '') NOT IN ('header', 'folio') AND length(t) BETWEEN 1 AND 120),
sp AS (SELECT book_id, min(page_no) AS first, max(page_no) AS last FROM {src} GROUP BY book_id),
h0 AS (SELECT book_id, page_no, k, 'front' AS side, {case('front')} AS hit FROM c UNION ALL SELECT book_id, page_no, k, 'back', {case('back')} FROM c),
h AS (SELECT book_id, page_no, side, arg_min(hit[3:], k) AS kind FROM h0 WHERE hit IS NOT NULL GROUP BY ALL),
n AS (SELECT h.*, lead(page_no) OVER (PARTITION BY h.book_id, side ORDER BY page_no) AS nxt, first, last, CASE WHEN last - first + 1 <= 10 THEN last - first + 1 ELSE greatest(10, ceil((last - first + 1) * 0.2)) END AS reach FROM h JOIN sp USING (book_id))
SELECT book_id, side, kind, min(page_no) AS lo, arg_min(coalesce(nxt - 1, last), page_no) AS hi FROM n WHERE CASE WHEN side = 'front' THEN page_no < first + reach ELSE page_no > last - reach END GROUP BY book_id, side, kind"""


_LATEST = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM sections) WHERE rn = 1)"
_BD = "bd AS (SELECT book_id, start_page AS page_no, coalesce(title, '') AS title FROM ls WHERE start_page IS NOT NULL)"
_DEDUP = """bs AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no, title) AS i FROM (SELECT DISTINCT * FROM bd)),
fo AS (SELECT book_id, i, page_no, title, page_no AS kept, true AS keep FROM bs WHERE i = 1
  UNION ALL SELECT bs.book_id, bs.i, bs.page_no, bs.title, CASE WHEN bs.page_no - fo.kept > 2 THEN bs.page_no ELSE fo.kept END, bs.page_no - fo.kept > 2 FROM fo JOIN bs ON bs.book_id = fo.book_id AND bs.i = fo.i + 1),
dd AS (SELECT book_id, page_no, title FROM fo WHERE keep)"""
_PT = "pt AS (SELECT book_id, page_no, string_agg(text, {0} ORDER BY block_idx) AS text FROM b WHERE classification IN ({1}) AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') GROUP BY ALL)"
_BODY = "SELECT book_id, page_no, sum(length(text) + 1) AS n FROM b WHERE classification = 'body' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') GROUP BY ALL"
_PI = "pi AS (SELECT book_id, page_no, coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, n - 1 AS chars FROM pg)"
_WIN = "w AS (SELECT book_id, CAST(i AS BIGINT) AS win, CAST(i * {0} + 1 AS BIGINT) AS lo, least((i + 1) * {0}, last) AS hi FROM (SELECT book_id, max(page_no) AS last FROM b GROUP BY book_id), LATERAL (SELECT unnest(range(0, (last - 1) // {0} + 1)) AS i))"



def _CROSS(size: int) -> str:
    return f"""{_BL}, {_WIN.format(size)}, {_LATEST}, o AS (SELECT DISTINCT book_id, start_page AS p, (start_page - 1) // {size} AS win FROM ls WHERE start_page IS NOT NULL AND source IN ('outline', 'spine')),
m AS (SELECT DISTINCT book_id, start_page AS p, (start_page - 1) // {size} AS win FROM ls WHERE start_page IS NOT NULL AND source = 'llm-detected'),
lp AS (SELECT book_id, max(page_no) AS last FROM b GROUP BY book_id), oo AS (SELECT o.* FROM o JOIN lp USING (book_id) WHERE p BETWEEN 1 AND last), mm AS (SELECT m.* FROM m JOIN lp USING (book_id) WHERE p BETWEEN 1 AND last),
ck AS (SELECT book_id, win, NOT EXISTS (SELECT 1 FROM oo WHERE oo.book_id = w.book_id AND oo.win = w.win AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.book_id = oo.book_id AND mm.win = oo.win AND abs(mm.p - oo.p) <= 2))
AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.book_id = w.book_id AND mm.win = w.win AND NOT EXISTS (SELECT 1 FROM oo WHERE mm.book_id = oo.book_id AND mm.win = oo.win AND abs(mm.p - oo.p) <= 2)) AS matched FROM w)"""


SQL = {
    "header_footer_texts": f"WITH {_BL}, {_EDGE}, {_REP} SELECT book_id, text, pages FROM rep",
    "classify_blocks": f"""WITH {_BL}, {_EDGE}, {_REP},
x AS (SELECT b.*, {_T.format('b.text')} AS t, block_idx = lo AS top, block_idx = hi AS bottom FROM b JOIN e USING (book_id, page_no))
SELECT x.rec_id, CASE WHEN coalesce(t, '') = '' THEN 'body' WHEN rep.text IS NOT NULL AND top THEN 'header' WHEN rep.text IS NOT NULL AND bottom THEN 'footer'
WHEN regexp_matches(t, '(?i)^([ivxlcdm]+|[0-9]{{1,4}})$') AND length(t) <= 6 AND (top OR bottom) THEN 'folio' WHEN regexp_matches(t, '(?i)^(figure|fig\\.|table|plate|diagram|map)\\b') AND length(t) < 200 THEN 'caption'
WHEN bottom AND regexp_matches(t, '^[¹²³⁰⁴-⁹*†‡§]|^[0-9]{{1,3}}[.)][ \\t]+[^ \\t\\n]') THEN 'footnote' ELSE 'body' END AS kind FROM x LEFT JOIN rep ON rep.book_id = x.book_id AND rep.text = x.t""",
    "verse_runs": f"WITH {_BL}, {_verse(3)} SELECT book_id, page_no, lo, hi, lines FROM v",
    "cast_runs": f"WITH {_BL}, {_verse(3)}, {_castsql('b')} SELECT book_id, page_no, lo, hi FROM c",
    "protected_blocks": f"""WITH {_BL}, {_verse(3)}, {_castsql('b')}
SELECT * FROM (SELECT rec_id, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.book_id = b.book_id AND v.page_no = b.page_no AND b.block_idx BETWEEN v.lo AND v.hi) THEN 'verse'
WHEN EXISTS (SELECT 1 FROM c WHERE c.book_id = b.book_id AND c.page_no = b.page_no AND b.block_idx BETWEEN c.lo AND c.hi) THEN 'cast'
WHEN regexp_matches(lower(coalesce(font_hint, '')), '{'|'.join(B.FONTS)}') THEN 'font' END AS reason FROM b WHERE classification = 'body') WHERE reason IS NOT NULL""",
    "front_back_matter": f"WITH {_BL}, {_mattersql('b')}",
    "page_texts": f"WITH {_BL}, {_PT.format('chr(10)', chr(39) + 'body' + chr(39))} SELECT book_id, page_no, md5(text) AS text, length(text) AS chars FROM pt",
    "no_text_layer": f"WITH {_BL} SELECT book_id, count(DISTINCT page_no) AS pages, coalesce(sum(length(text)), 0) AS chars, count(DISTINCT page_no) > 5 AND coalesce(sum(length(text)), 0) < 100 AS no_text FROM b GROUP BY book_id",
    "page_index": f"WITH {_BL}, pg AS ({_BODY}), {_PI} SELECT * FROM pi",
    "offset_to_page": f"""WITH {_BL}, pg AS ({_BODY}), {_PI}, p AS (SELECT DISTINCT rec_id, book_id, start_off FROM nodes WHERE start_off IS NOT NULL)
SELECT p.rec_id, p.start_off, pi.page_no FROM p ASOF JOIN pi ON p.book_id = pi.book_id AND p.start_off >= pi.start""",
    "page_windows": f"WITH {_BL}, {_WIN.format(10)} SELECT * FROM w",
    "sample_windows": f"""WITH {_BL}, {_WIN.format(5)}, n AS (SELECT book_id, count(*) AS n, least(count(*), greatest(1, floor(count(*) * 0.4 + 0.5))) AS c FROM w GROUP BY book_id),
k AS (SELECT DISTINCT book_id, CAST(floor(i * n / c) AS BIGINT) AS win FROM n, LATERAL (SELECT unnest(range(0, CAST(c AS BIGINT))) AS i)) SELECT w.* FROM w JOIN k USING (book_id, win)""",
    "window_text": f"""WITH {_BL}, {_PT.format(chr(39) + ' ' + chr(39), "'body', 'header', 'caption'")}, x AS (SELECT book_id, CAST((page_no - 1) // 10 AS BIGINT) AS win, string_agg('--- page ' || page_no || ' ---' || chr(10) || text, chr(10) ORDER BY page_no) AS text FROM pt GROUP BY ALL)
SELECT book_id, win, md5(text) AS text, length(text) AS chars FROM x""",
    "boundary_crosscheck": f"WITH {_CROSS(50)} SELECT * FROM ck",
    "boundary_crosscheck_10": f"WITH {_CROSS(10)} SELECT * FROM ck",
    "disagreement": f"WITH {_CROSS(10)} SELECT book_id, count(*) AS windows, count(*) FILTER (NOT matched) / count(*) AS ratio, count(*) FILTER (NOT matched) / count(*) > 0.3 AS hybrid FROM ck GROUP BY book_id",
    "mean_confidence": f"WITH {_LATEST} SELECT book_id, round(avg(confidence), 9) AS confidence, avg(confidence) < 0.4 AS low FROM ls GROUP BY book_id",
    "dedupe_ranked": f"""WITH RECURSIVE {_LATEST}, bs AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no, rank, title) AS i FROM
(SELECT DISTINCT book_id, start_page AS page_no, coalesce(title, '') AS title, CASE WHEN source IN ('outline', 'spine') THEN 0 ELSE 1 END AS rank FROM ls WHERE start_page IS NOT NULL)),
fo AS (SELECT book_id, i, page_no, title, page_no AS kept, true AS keep FROM bs WHERE i = 1
  UNION ALL SELECT bs.book_id, bs.i, bs.page_no, bs.title, CASE WHEN bs.page_no - fo.kept > 2 THEN bs.page_no ELSE fo.kept END, bs.page_no - fo.kept > 2 FROM fo JOIN bs ON bs.book_id = fo.book_id AND bs.i = fo.i + 1)
SELECT book_id, page_no, title FROM fo WHERE keep""",
    "split_at_cuts": f"""WITH {_BL}, {_LATEST}, s AS (SELECT * FROM ls WHERE start_page <= end_page),
e AS (SELECT s.rec_id, s.book_id, b.page_no, b.block_idx, CASE WHEN classification = 'body' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN length(text) END AS n,
  row_number() OVER (PARTITION BY s.rec_id ORDER BY b.page_no, block_idx) AS k FROM s JOIN b ON b.book_id = s.book_id AND b.page_no BETWEEN s.start_page AND s.end_page),
t AS (SELECT rec_id, max(k) AS blocks FROM e GROUP BY rec_id), c AS (SELECT rec_id, block_no FROM t, (VALUES (1), (4), (9)) v(block_no) WHERE rec_id % 3 = 0 AND block_no > 1 AND block_no <= blocks),
p0 AS (SELECT e.*, sum(CASE WHEN c.block_no IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.rec_id ORDER BY k) AS part FROM e LEFT JOIN c ON c.rec_id = e.rec_id AND c.block_no = e.k),
p AS (SELECT rec_id, book_id, part, min(page_no) AS lo, max(page_no) AS hi, greatest(coalesce(sum(n + 1), 0) - 1, 0) AS chars FROM p0 GROUP BY ALL),
nm AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY block_no) - 1 AS part, 'Part ' || block_no AS ct FROM c)
SELECT p.book_id, p.rec_id, row_number() OVER (PARTITION BY p.book_id ORDER BY coalesce(s.ord, 0), p.rec_id, p.part) AS ord,
  CASE WHEN p.rec_id NOT IN (SELECT rec_id FROM c) THEN coalesce(s.title, '') ELSE coalesce(ct, coalesce(s.title, '') || ' (cont.)') END AS title,
  CASE WHEN p.rec_id NOT IN (SELECT rec_id FROM c) THEN s.confidence ELSE 0.6 END AS confidence, lo, hi, chars FROM p JOIN s USING (rec_id) LEFT JOIN nm ON nm.rec_id = p.rec_id AND nm.part = p.part""",
    "flatten_outline": """WITH RECURSIVE n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, node_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM nodes) WHERE rn = 1),
c AS (SELECT book_id, node_id, 0 AS depth, printf('%08d', coalesce(ord, 0)) || ':' || node_id AS path, title, start_page FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.book_id, n.node_id, c.depth + 1, c.path || chr(1) || printf('%08d', coalesce(n.ord, 0)) || ':' || n.node_id, n.title, n.start_page FROM n JOIN c ON c.book_id = n.book_id AND c.node_id = n.parent_id)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY path) AS pos, node_id, depth, title, start_page FROM c""",
    "dedupe_boundaries": f"WITH RECURSIVE {_LATEST}, {_BD}, {_DEDUP} SELECT * FROM dd",
    "sections": f"""WITH RECURSIVE {_BL}, {_LATEST}, {_BD}, {_DEDUP}, op AS (SELECT * FROM dd UNION ALL SELECT book_id, 1, 'Opening' FROM dd GROUP BY book_id HAVING min(page_no) > 1),
l AS (SELECT book_id, max(page_no) AS last FROM b GROUP BY book_id), x AS (SELECT *, row_number() OVER w AS ord, lead(page_no) OVER w AS nxt FROM op WINDOW w AS (PARTITION BY book_id ORDER BY page_no, title))
SELECT book_id, ord, title, page_no AS start_page, least(greatest(page_no, coalesce(nxt - 1, last)), greatest(last, page_no)) AS end_page FROM x JOIN l USING (book_id)""",
    "spine_sections": f"""WITH {_BL}, f AS (SELECT book_id, spine_item_id, min(page_no) AS start_page FROM b WHERE spine_item_id IS NOT NULL GROUP BY ALL),
t AS (SELECT book_id, page_no AS start_page, arg_min(text, block_idx) AS t FROM b WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') GROUP BY ALL), x AS (SELECT f.*, t.t, row_number() OVER (PARTITION BY f.book_id ORDER BY f.start_page, spine_item_id) AS ord FROM f LEFT JOIN t USING (book_id, start_page))
SELECT book_id, spine_item_id, ord, start_page, coalesce(nullif(left({_T.format('t')}, 80), ''), 'Spine item ' || ord) AS title FROM x""",
    "slice_preamble": f"WITH {_BL}, pg AS (SELECT book_id, page_no - 2 AS page_no, n FROM ({_BODY}) WHERE page_no >= 3), {_PI} SELECT * FROM pi",
    "split_sections": f"""WITH {_BL}, {_LATEST}, s AS (SELECT rec_id, book_id, unnest(range(start_page, end_page + 1)) AS page_no FROM ls WHERE start_page <= end_page),
y AS (SELECT s.book_id, s.rec_id, page_no, block_idx, length(text) + 1 AS n FROM s JOIN b USING (book_id, page_no) WHERE classification = 'body' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')),
x AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY page_no, block_idx) AS upto, sum(n) OVER (PARTITION BY rec_id) AS total FROM y)
SELECT book_id, rec_id, CAST((upto - n) // 3000 AS BIGINT) AS part, min(page_no) AS lo, max(page_no) AS hi, sum(n) AS chars FROM x WHERE total > 3000 GROUP BY book_id, rec_id, CAST((upto - n) // 3000 AS BIGINT)""",
}
