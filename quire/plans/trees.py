"""Queries over the trees of books, their curation and export plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import curation as C
from quire.operators import tree as T
from quire.operators.intervals import latest
from quire.operators.ordered import numbered
from quire.plans.blocks import _bounds
from quire.session import checkpointed
from quire.tables import table


def _n(s, d):
    return T.current(table(s, d, "nodes"))


def _once(n):
    """The nodes without their texts, made once, for queries that walk the tree."""
    return checkpointed(n.drop("summary_text"))


def _inc(n):
    """A leaf is left out where its summary is known to be short: a flag that the data carry."""
    return n.where("is_leaf and summary_words is not null").select("book_id", F.col("node_id").alias("leaf_id"), (F.col("summary_words") >= 40).alias("included"))


def _with(f):
    def run(s, d):
        n = _n(s, d)
        return f(s, d, n, _inc(n))

    return run


def _tree(f):
    def run(s, d):
        n = _once(_n(s, d))
        return f(s, d, n, _inc(n))

    return run


def _texts(s, d):
    """The sections with blank lines between their lines."""
    x = table(s, d, "sections", "rec_id", "raw_text").dropDuplicates(["rec_id"]).where("raw_text is not null")
    return x.select(F.col("rec_id").alias("id"), F.replace("raw_text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _kids(s, d):
    """Twelve proposed children of each section, some empty, some overlapping, some beyond its end."""
    t = checkpointed(_texts(s, d))
    k = F.col("k")
    p = t.select("id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("id", F.concat(F.lit("c"), k.cast("string")).alias("title"), (k * 310).alias("start_off"), (k * 310 + (k % 3) * 290).alias("end_off"))
    return T.reconciled(p, t)


def _snaps(s, d):
    at = _texts(s, d).select("id", "text", F.explode(F.array(F.lit(150), F.lit(700), F.lit(2600))).alias("place")).where("place < length(text)")
    return at.select("id", "place", T.snapped(F.col("text"), F.col("place")).alias("snapped"))


def _books(s, d):
    return table(s, d, "books", "book_id", "page_count")


def _heap(s, d):
    """The sections of a book as a binary heap in their order: trees as deep as the logarithm of their number."""
    x = latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["ord", "title"])
    order = [F.col("ord").asc_nulls_last(), "section_id"]
    n = numbered(x, ["book_id"], F.floor(F.coalesce("ord", F.lit(1 << 30)) / 64), order, "k").select("book_id", "k", F.concat(F.lit("t"), (F.col("k") % 10).cast("string")).alias("title"))
    half = F.floor(F.col("k") / 2)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return checkpointed(n.select("book_id", name(F.col("k")).alias("node_id"), F.when(half > 0, name(half)).alias("parent_id"), "title"))


def _merged(n, i):
    return checkpointed(C.merged(C.fragments(n, i)))


def _edits(s, d):
    full = checkpointed(_n(s, d))
    n = full.drop("summary_text")
    _, gone = C.export_plan(n, _inc(n), _books(s, d))
    return C.edit_plan(gone, n, full.select("book_id", "node_id", F.col("summary_text").alias("text")).where("text is not null"))


QUERIES = {
    "title_chain": _tree(lambda s, d, n, i: T.title_chains(n)),
    "deep_tree": lambda s, d: T.title_chains(_heap(s, d), "/"),
    "descendant_leaves": _tree(lambda s, d, n, i: T.descendant_leaves(n)),
    "count_leaves": _tree(lambda s, d, n, i: T.leaf_counts(n)),
    "leaf_flags": _with(lambda s, d, n, i: T.leaf_flags(n)),
    "ontology_listing": _tree(lambda s, d, n, i: T.listing(n)),
    "downstream_leaves": _tree(lambda s, d, n, i: T.downstream_leaves(n)),
    "dependency_edges": _tree(lambda s, d, n, i: T.dependency_edges(n)),
    "inclusion_state": _tree(lambda s, d, n, i: C.states(n, i)),
    "fragments": _tree(lambda s, d, n, i: C.fragments(n, i)),
    "merge_brackets": _tree(lambda s, d, n, i: C.merged(C.fragments(n, i))),
    "fragment_pages": _tree(lambda s, d, n, i: C.fragment_pages(n, _merged(n, i))),
    "preflight": _tree(lambda s, d, n, i: C.preflight(n, _merged(n, i))),
    "deletion_intervals": _tree(lambda s, d, n, i: C.export_plan(n, i, _books(s, d))[1]),
    "deletions_behind_preamble": _tree(lambda s, d, n, i: C.export_plan(n, i, _books(s, d), 2)[1]),
    "export_stats": _tree(lambda s, d, n, i: C.export_stats(n, i, _books(s, d))),
    "edit_plan": _edits,
    "set_inclusion": _tree(lambda s, d, n, i: C.set_to(n, i, n.where("depth = 1").select("book_id", "node_id", (F.col("ord") % 2 == 0).alias("to")))),
    "curate_stats": _tree(lambda s, d, n, i: C.leaf_inclusion(n, i).join(n.select("book_id", F.col("node_id").alias("leaf_id"), "start_page", "end_page"), ["book_id", "leaf_id"]).groupBy("book_id").agg(F.count("*").alias("leaves"), F.count_if("included").alias("kept"), F.coalesce(F.sum(F.when(F.col("included"), F.col("end_page") - F.col("start_page") + 1)), F.lit(0)).alias("kept_pages"))),
    "toggle_inclusion": _tree(lambda s, d, n, i: C.toggled(n, i, n.where("depth = 1"))),
    "apply_suggest": _tree(lambda s, d, n, i: C.applied(n, i, n.where("source = 'toc' and not is_leaf and summary_words < 50"))),
    "revert_suggest": _tree(lambda s, d, n, i: C.reverted(C.applied(n, i, n.where("source = 'toc' and not is_leaf and summary_words < 50")))),
    "suggest_budget": _with(lambda s, d, n, i: n.where("is_leaf and end_off > start_off").groupBy("book_id").agg(F.sum(F.col("end_off") - F.col("start_off")).alias("total")).select("book_id", "total", F.floor(F.col("total") * 0.4 + 0.5).alias("to_exclude"))),
    "suggest_leaves": _tree(lambda s, d, n, i: T.descendant_leaves(n).join(n.where("source = 'toc' and summary_words < 50").select("book_id", "node_id"), ["book_id", "node_id"], "left_semi").select("book_id", "leaf_id").distinct()),
    "spine_leaf_map": _tree(lambda s, d, n, i: C.spine_plan(B.records(table(s, d, "blocks", "rec_id", "book_id", "page_no", "spine_item_id")), n, i)),
    "seed_top_level": lambda s, d: T.seed_top_level(_bounds(s, d), B.page_index(B.records(table(s, d, "blocks", "rec_id", "book_id", "page_no", "block_idx", "text", "classification"))), 3000),
    "merge_undersized": _with(lambda s, d, n, i: T.merge_undersized(n.where("parent_id is not null and start_page is not null and end_page is not null").select(F.concat_ws("/", "book_id", "parent_id").alias("id"), F.col("start_page").alias("lo"), F.greatest("start_page", "end_page").alias("hi"), F.concat_ws(" ", "node_id", "title").alias("title")))),
    "reconcile_children": _kids,
    "snap_paragraph": _snaps,
    "summarize_tree": _with(lambda s, d, n, i: T.summarize_tree(n)),
}

_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, node_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM nodes) WHERE rn = 1)"
_UP = f"""RECURSIVE {_N}, up AS (SELECT book_id, node_id, node_id AS anc FROM n UNION ALL SELECT up.book_id, up.node_id, n.parent_id FROM up JOIN n ON n.book_id = up.book_id AND n.node_id = up.anc WHERE n.parent_id IS NOT NULL),
dl AS (SELECT up.book_id, up.anc AS node_id, up.node_id AS leaf_id FROM up JOIN n ON n.book_id = up.book_id AND n.node_id = up.node_id WHERE n.is_leaf)"""
_I = "i AS (SELECT book_id, node_id AS leaf_id, coalesce(summary_words >= 40, true) AS included FROM n WHERE is_leaf)"
_S = f"""{_UP}, {_I}, st AS (SELECT n.book_id, n.node_id, count(i.leaf_id) AS leaves, count(CASE WHEN i.included THEN 1 END) AS kept FROM n LEFT JOIN dl ON dl.book_id = n.book_id AND dl.node_id = n.node_id LEFT JOIN i ON i.book_id = dl.book_id AND i.leaf_id = dl.leaf_id GROUP BY ALL),
s AS (SELECT *, CASE WHEN kept = 0 THEN 'none' WHEN kept = leaves THEN 'all' ELSE 'mixed' END AS state FROM st)"""
_F = f"""{_S}, f AS (SELECT n.book_id, n.node_id, CASE WHEN s.state = 'all' THEN 'keep' ELSE 'bracket' END AS kind, n.start_off, n.end_off, s.leaves FROM n JOIN s USING (book_id, node_id)
LEFT JOIN s a ON a.book_id = n.book_id AND a.node_id = n.parent_id WHERE s.state <> 'mixed' AND s.leaves > 0 AND (a.state IS NULL OR a.state = 'mixed'))"""
_M = """m0 AS (SELECT *, CASE WHEN kind = 'bracket' AND lag(kind) OVER w = 'bracket' AND lag(end_off) OVER w = start_off THEN 0 ELSE 1 END AS nw
  FROM f WHERE start_off IS NOT NULL AND end_off IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY start_off, end_off, node_id)),
m1 AS (SELECT *, sum(nw) OVER (PARTITION BY book_id ORDER BY start_off, end_off, node_id) AS run FROM m0),
m AS (SELECT book_id, kind, arg_min(node_id, struct_pack(start_off, end_off, node_id)) AS node_id, min(start_off) AS start_off, max(end_off) AS end_off, count(*) AS parts,
  sum(end_off - start_off) AS chars FROM m1 GROUP BY book_id, run, kind)"""
_L = """ov AS (SELECT m.book_id, m.node_id, m.kind, m.start_off, l.node_id AS leaf_id, l.title, l.start_off AS ls, l.start_page, l.end_page
  FROM m JOIN n l ON l.book_id = m.book_id AND l.is_leaf AND l.end_off > m.start_off AND l.start_off < m.end_off AND l.start_off < l.end_off AND m.start_off < m.end_off)"""
_P = """p AS (SELECT book_id, node_id, kind, start_off, min(start_page) AS lo, max(end_page) AS hi FROM ov
  WHERE start_page IS NOT NULL AND end_page IS NOT NULL GROUP BY ALL)"""


def _D(offset: int = 0) -> str:
    return f"""q AS (SELECT p.*, unnest(range(greatest(lo + {offset}, 1 + {offset}), least(hi + {offset}, page_count) + 1)) AS page
  FROM p JOIN (SELECT DISTINCT book_id, page_count FROM books WHERE page_count IS NOT NULL) USING (book_id)),
g AS (SELECT book_id, page, arg_min(node_id, struct_pack(start_off, node_id)) FILTER (kind = 'bracket') AS node_id FROM q GROUP BY ALL HAVING count(*) FILTER (kind = 'keep') = 0),
r AS (SELECT *, page - row_number() OVER (PARTITION BY book_id, node_id ORDER BY page) AS run FROM g),
d AS (SELECT book_id, node_id, min(page) AS lo, max(page) AS hi FROM r GROUP BY book_id, node_id, run)"""


_PLAN = f"{_F}, {_M}, {_L}, {_P}"
_HINT = "CASE WHEN chars <= 1500 THEN 'one-line' WHEN chars <= 7500 THEN 'short' WHEN chars <= 30000 THEN 'medium' WHEN chars IS NOT NULL THEN 'long' END"
_SUG = "source = 'toc' AND NOT is_leaf AND summary_words < 50"
_W = "[ \\t\\n\\r\\f\\v]"
_LIST = f"list_filter(regexp_split_to_array({{0}}, '{_W}+'), lambda w: w <> '')"


def _first(text: str, most: int) -> str:
    ws = _LIST.format(text)
    return f"CASE WHEN len({ws}) <= {most} THEN regexp_replace(regexp_replace({text}, '^{_W}+', ''), '{_W}+$', '') ELSE regexp_replace(array_to_string({ws}[1:{most}], ' '), '[,;: ]+$', '') || '…' END"


def _rollup() -> str:
    steps = [f"l9 AS (SELECT book_id, node_id, {_first(chr(39) * 2 + ' || coalesce(summary_text, ' + chr(39) * 2 + ')', 12)} AS summary FROM n WHERE is_leaf)"]
    last = "l9"
    for k in range(6, -1, -1):
        steps.append(f"t{k} AS (SELECT p.book_id, p.node_id, string_agg(x.summary, ' ' ORDER BY c.ord, c.node_id) AS t FROM {last} x JOIN n c USING (book_id, node_id) JOIN n p ON p.book_id = c.book_id AND p.node_id = c.parent_id WHERE p.depth = {k} AND NOT p.is_leaf GROUP BY ALL)")
        steps.append(f"l{k} AS (SELECT * FROM {last} UNION ALL SELECT book_id, node_id, {_first('t', 60)} FROM t{k})")
        last = f"l{k}"
    return f"WITH {_N}, " + ", ".join(steps) + f" SELECT book_id, node_id, summary FROM {last}"


_TX = "tx AS (SELECT DISTINCT rec_id AS id, replace(raw_text, chr(10), chr(10) || chr(10)) AS text FROM sections WHERE raw_text IS NOT NULL)"


def _snap(at: str) -> str:
    """The end of the blank line nearest to a place, of equal ones the earlier."""
    lo, hi = f"CAST(greatest({at} - 400, 0) AS BIGINT)", f"CAST(least({at} + 400, length(text)) AS BIGINT)"
    near = f"list_filter(range({lo}, greatest({hi}, {lo} + 1)), lambda i: text[i + 1:i + 2] = chr(10) || chr(10))"
    return f"coalesce(list_min(list_transform({near}, lambda i: abs(i - {at}) * 1000000 + i)) % 1000000 + 2, {at})"


SQL = {
    "snap_paragraph": f"WITH {_TX} SELECT id, place, CAST({_snap('place')} AS INT) AS snapped FROM tx, (VALUES (150), (700), (2600)) v(place) WHERE place < length(text)",
    "reconcile_children": f"""WITH RECURSIVE {_TX}, p AS (SELECT id, text, length(text) AS n, 'c' || k AS title, least(k * 310, length(text)) AS s, least(k * 310 + k % 3 * 290, length(text)) AS e FROM tx, range(0, 12) r(k)),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e, title) AS k, count(*) OVER (PARTITION BY id) AS m FROM p WHERE e > s),
z AS (SELECT id, n, title, k, CASE WHEN k = m THEN n ELSE {_snap('e')} END AS stop FROM q),
f AS (SELECT id, n, k, title, CAST(0 AS BIGINT) AS start, CASE WHEN stop > 0 THEN stop ELSE 0 END AS top, stop > 0 AS keep FROM z WHERE k = 1
  UNION ALL SELECT z.id, z.n, z.k, z.title, f.top, CASE WHEN z.stop > f.top THEN z.stop ELSE f.top END, z.stop > f.top FROM f JOIN z ON z.id = f.id AND z.k = f.k + 1),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i, count(*) OVER (PARTITION BY id) AS m FROM f WHERE keep)
SELECT id, CASE WHEN i = 8 AND m > 8 THEN 'Remaining material' ELSE title END AS title, CAST(start AS INT) AS start_off, CAST(CASE WHEN i = least(m, 8) THEN n ELSE top END AS INT) AS end_off FROM g WHERE i <= 8""",
    "title_chain": f"WITH RECURSIVE {_N}, c AS (SELECT book_id, node_id, coalesce(title, '') AS chain FROM n WHERE parent_id IS NULL UNION ALL SELECT n.book_id, n.node_id, c.chain || ' › ' || coalesce(n.title, '') FROM n JOIN c ON c.book_id = n.book_id AND c.node_id = n.parent_id) SELECT * FROM c",
    "deep_tree": """WITH RECURSIVE ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM sections) WHERE rn = 1),
h AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord NULLS LAST, section_id) AS k FROM ls),
c AS (SELECT book_id, k, 't' || k % 10 AS chain FROM h WHERE k = 1 UNION ALL SELECT h.book_id, h.k, c.chain || '/t' || h.k % 10 FROM c JOIN h ON h.book_id = c.book_id AND h.k // 2 = c.k)
SELECT book_id, 'n' || k AS node_id, chain FROM c""",
    "descendant_leaves": f"WITH {_UP} SELECT * FROM dl",
    "count_leaves": f"WITH {_UP} SELECT n.book_id, n.node_id, count(dl.leaf_id) AS leaves, n.end_off - n.start_off AS chars FROM n LEFT JOIN dl USING (book_id, node_id) GROUP BY n.book_id, n.node_id, n.end_off - n.start_off",
    "leaf_flags": f"WITH {_N} SELECT book_id, node_id, depth >= 6 OR coalesce(end_page - start_page + 1, ceil((end_off - start_off) / 2500.0)) <= 5 OR end_off - start_off < 7500 AS stop FROM n",
    "ontology_listing": f"WITH RECURSIVE {_N}, c AS (SELECT book_id, node_id, coalesce(title, '') AS chain FROM n WHERE parent_id IS NULL UNION ALL SELECT n.book_id, n.node_id, c.chain || ' › ' || coalesce(n.title, '') FROM n JOIN c ON c.book_id = n.book_id AND c.node_id = n.parent_id) SELECT n.book_id, row_number() OVER (PARTITION BY n.book_id ORDER BY start_off NULLS LAST, depth, n.node_id) AS pos, n.node_id, chain, end_off - start_off AS chars FROM n JOIN c USING (book_id, node_id)",
    "downstream_leaves": f"WITH {_N}, l AS (SELECT book_id, node_id AS leaf_id, start_off, row_number() OVER (PARTITION BY book_id ORDER BY start_off, node_id) AS pos FROM n WHERE is_leaf AND start_off IS NOT NULL) SELECT book_id, node_id, leaf_id, pos FROM (SELECT n.book_id, n.node_id, l.leaf_id, l.pos, row_number() OVER (PARTITION BY n.book_id, n.node_id ORDER BY l.pos) AS k FROM n JOIN l ON l.book_id = n.book_id AND l.start_off >= n.end_off WHERE NOT n.is_leaf) WHERE k <= 80",
    "dependency_edges": f"""WITH {_N}, w AS (SELECT book_id, node_id, is_leaf, start_off, end_off, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-zà-ÿ]+'), lambda x: length(x) > 4) AS ws FROM n),
l AS (SELECT book_id, node_id AS leaf_id, start_off, ws, row_number() OVER (PARTITION BY book_id ORDER BY start_off, node_id) AS pos FROM w WHERE is_leaf AND start_off IS NOT NULL),
p AS (SELECT w.book_id, w.node_id, w.ws AS a, l.leaf_id, l.ws AS b, row_number() OVER (PARTITION BY w.book_id, w.node_id ORDER BY l.pos) AS k FROM w JOIN l ON l.book_id = w.book_id AND l.start_off >= w.end_off WHERE NOT w.is_leaf)
SELECT book_id, node_id, leaf_id FROM p WHERE k <= 80 AND list_has_any(a, b)""",
    "inclusion_state": f"WITH {_S} SELECT book_id, node_id, state, leaves, kept FROM s",
    "fragments": f"WITH {_F} SELECT * FROM f",
    "merge_brackets": f"WITH {_F}, {_M} SELECT *, {_HINT} AS hint FROM m",
    "fragment_pages": f"WITH {_PLAN} SELECT * FROM p",
    "preflight": f"""WITH {_PLAN}, x AS (SELECT DISTINCT book_id, leaf_id, ls, title FROM ov WHERE start_page IS NULL OR end_page IS NULL)
SELECT book_id, count(*) AS missing, arg_min(coalesce(title, chr(0)), struct_pack(ls, leaf_id)) AS title FROM x GROUP BY book_id""",
    "deletion_intervals": f"WITH {_PLAN}, {_D()} SELECT * FROM d",
    "deletions_behind_preamble": f"WITH {_PLAN}, {_D(2)} SELECT * FROM d",
    "export_stats": f"""WITH {_PLAN}, {_D()}
SELECT b.book_id, b.page_count AS pages, coalesce(x.deleted, 0) AS deleted, b.page_count - coalesce(x.deleted, 0) AS kept, coalesce(x.brackets, 0) AS brackets,
  b.book_id NOT IN (SELECT book_id FROM ov WHERE start_page IS NULL OR end_page IS NULL) AS exportable
FROM (SELECT DISTINCT book_id, page_count FROM books WHERE page_count IS NOT NULL) b
LEFT JOIN (SELECT book_id, sum(hi - lo + 1) AS deleted, count(DISTINCT node_id) AS brackets FROM d GROUP BY book_id) x USING (book_id)""",
    "edit_plan": f"""WITH {_PLAN}, {_D()},
e AS (SELECT d.*, row_number() OVER (PARTITION BY d.book_id ORDER BY d.lo DESC, d.node_id) AS step, coalesce(n.title, 'Excluded section') AS title,
  coalesce(n.summary_text, '[Editorial bracket unavailable.]') AS text FROM d LEFT JOIN n USING (book_id, node_id)),
w AS (SELECT book_id, step, {_LIST.format('text')} AS ws FROM e),
wr AS (SELECT book_id, step, ws, 1 AS i, length(ws[1]) AS wide, 1 AS lines FROM w WHERE len(ws) > 0
  UNION ALL SELECT book_id, step, ws, i + 1, CASE WHEN wide + 1 + length(ws[i + 1]) <= 84 THEN wide + 1 + length(ws[i + 1]) ELSE length(ws[i + 1]) END,
    CASE WHEN wide + 1 + length(ws[i + 1]) <= 84 THEN lines ELSE lines + 1 END FROM wr WHERE i < len(ws)),
z AS (SELECT book_id, step, max(lines) AS lines FROM wr GROUP BY ALL)
SELECT e.book_id, e.step, e.node_id, e.lo, e.hi, e.title, e.text, CAST(greatest(1, ceil(coalesce(z.lines, 0) / 41.0)) AS INT) AS inserted FROM e LEFT JOIN z USING (book_id, step)""",
    "set_inclusion": f"""WITH {_UP}, {_I}, u AS (SELECT dl.book_id, dl.leaf_id, bool_and(n.ord % 2 = 0) AS t FROM dl JOIN n USING (book_id, node_id) WHERE n.depth = 1 GROUP BY ALL)
SELECT i.book_id, i.leaf_id, coalesce(u.t, i.included) AS included FROM i LEFT JOIN u USING (book_id, leaf_id)""",
    "curate_stats": f"WITH {_N}, {_I} SELECT i.book_id, count(*) AS leaves, count(CASE WHEN included THEN 1 END) AS kept, coalesce(sum(CASE WHEN included THEN end_page - start_page + 1 END), 0) AS kept_pages FROM i JOIN n ON n.book_id = i.book_id AND n.node_id = i.leaf_id GROUP BY i.book_id",
    "toggle_inclusion": f"WITH {_S}, u AS (SELECT dl.book_id, dl.leaf_id, bool_or(s.state <> 'all') AS t FROM dl JOIN s USING (book_id, node_id) JOIN n USING (book_id, node_id) WHERE n.depth = 1 GROUP BY ALL) SELECT i.book_id, i.leaf_id, coalesce(u.t, i.included) AS included FROM i LEFT JOIN u USING (book_id, leaf_id)",
    "apply_suggest": f"WITH {_UP}, {_I}, x AS (SELECT DISTINCT dl.book_id, dl.leaf_id FROM dl JOIN n USING (book_id, node_id) WHERE {_SUG}) SELECT i.book_id, i.leaf_id, i.included AND x.leaf_id IS NULL AS included, i.included AS before FROM i LEFT JOIN x USING (book_id, leaf_id)",
    "revert_suggest": f"WITH {_N}, {_I} SELECT * FROM i",
    "suggest_budget": f"WITH {_N} SELECT book_id, sum(end_off - start_off) AS total, floor(sum(end_off - start_off) * 0.4 + 0.5) AS to_exclude FROM n WHERE is_leaf AND end_off > start_off GROUP BY book_id",
    "suggest_leaves": f"WITH {_UP} SELECT DISTINCT dl.book_id, dl.leaf_id FROM dl JOIN n USING (book_id, node_id) WHERE source = 'toc' AND summary_words < 50",
    "spine_leaf_map": f"WITH {_N}, {_I}, it AS (SELECT DISTINCT book_id, page_no, spine_item_id FROM blocks WHERE spine_item_id IS NOT NULL), lf AS (SELECT n.book_id, n.node_id AS leaf_id, unnest(range(start_page, end_page + 1)) AS page_no, included FROM n JOIN i ON i.book_id = n.book_id AND i.leaf_id = n.node_id WHERE start_page <= end_page), h AS (SELECT book_id, spine_item_id, count(DISTINCT leaf_id) AS leaves, bool_or(included) AS anyk FROM it JOIN lf USING (book_id, page_no) GROUP BY ALL) SELECT book_id, spine_item_id, coalesce(leaves, 0) AS leaves, coalesce(NOT anyk, false) AS replaced FROM (SELECT DISTINCT book_id, spine_item_id FROM it) LEFT JOIN h USING (book_id, spine_item_id)",
    "seed_top_level": """WITH RECURSIVE b AS (SELECT DISTINCT rec_id, book_id, page_no, block_idx, text, classification FROM blocks),
pg AS (SELECT book_id, page_no, sum(length(text) + 1) AS n FROM b WHERE classification = 'body' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') GROUP BY ALL),
pi AS (SELECT book_id, page_no, coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, n - 1 AS chars FROM pg),
tt AS (SELECT book_id, max(start + chars) AS total FROM pi GROUP BY book_id),
ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM sections) WHERE rn = 1),
x0 AS (SELECT ls.book_id, start_page, coalesce(title, '') AS title, pi.start, lead(pi.start) OVER (PARTITION BY ls.book_id ORDER BY start_page, coalesce(title, '')) AS nxt FROM ls JOIN pi ON pi.book_id = ls.book_id AND pi.page_no = ls.start_page),
x AS (SELECT x0.book_id, start, title, coalesce(nxt, total) AS stop, total, row_number() OVER (PARTITION BY x0.book_id ORDER BY start, title, coalesce(nxt, total)) AS i FROM x0 JOIN tt USING (book_id) WHERE coalesce(nxt, total) > start),
fo AS (SELECT book_id, i, start, title, stop, 1 AS g, total FROM x WHERE i = 1 UNION ALL
 SELECT x.book_id, x.i, CASE WHEN x.stop - x.start < 3000 THEN fo.start ELSE x.start END, CASE WHEN x.stop - x.start < 3000 THEN fo.title ELSE x.title END, x.stop, CASE WHEN x.stop - x.start < 3000 THEN fo.g ELSE fo.g + 1 END, x.total FROM fo JOIN x ON x.book_id = fo.book_id AND x.i = fo.i + 1),
gg AS (SELECT book_id, g, arg_max(title, i) AS title, arg_max(start, i) AS start, arg_max(stop, i) AS stop, min(total) AS total FROM fo GROUP BY book_id, g)
SELECT book_id, title, CASE WHEN g = 1 THEN 0 ELSE start END AS start_off, CASE WHEN g = max(g) OVER (PARTITION BY book_id) THEN total ELSE stop END AS end_off FROM gg""",
    "merge_undersized": f"""WITH RECURSIVE {_N}, x0 AS (SELECT book_id || '/' || parent_id AS id, start_page AS lo, greatest(start_page, end_page) AS hi, concat_ws(' ', node_id, title) AS title FROM n WHERE parent_id IS NOT NULL AND start_page IS NOT NULL AND end_page IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lo, hi, title) AS i FROM x0),
fo AS (SELECT id, i, lo, hi, title, 1 AS g FROM x WHERE i = 1 UNION ALL
 SELECT x.id, x.i, CASE WHEN x.hi - x.lo + 1 < 3 OR fo.hi - fo.lo + 1 < 3 THEN fo.lo ELSE x.lo END, x.hi, CASE WHEN x.hi - x.lo + 1 < 3 THEN fo.title ELSE x.title END, CASE WHEN x.hi - x.lo + 1 < 3 OR fo.hi - fo.lo + 1 < 3 THEN fo.g ELSE fo.g + 1 END FROM fo JOIN x ON x.id = fo.id AND x.i = fo.i + 1),
gg AS (SELECT id, g, arg_max(title, i) AS title, arg_max(lo, i) AS lo, arg_max(hi, i) AS hi FROM fo GROUP BY id, g),
mx AS (SELECT *, max(g) OVER (PARTITION BY id) AS m, lag(title) OVER (PARTITION BY id ORDER BY g) AS pt, lag(lo) OVER (PARTITION BY id ORDER BY g) AS pl, lead(hi) OVER (PARTITION BY id ORDER BY g) AS nh, lead(lo) OVER (PARTITION BY id ORDER BY g) AS nl FROM gg)
SELECT id, title, lo, CASE WHEN m >= 2 AND g = m - 1 AND nh - nl + 1 < 3 THEN nh ELSE hi END AS hi FROM mx WHERE NOT (m >= 2 AND g = m AND hi - lo + 1 < 3)""",
    "summarize_tree": _rollup(),
}
