"""Queries through a model provider; the extractive one and one that fails by rule are deterministic, so SQL can follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import wrap_untrusted
from quire.operators import blocks as B
from quire.operators import curation as C
from quire.operators import model as M
from quire.operators import structure as S
from quire.operators import tree as T
from quire.plans.blocks import COLS
from quire.plans.trees import _F, _HINT, _M, _N, _inc, _n
from quire.session import checkpointed
from quire.tables import table


def _sections(s, d):
    return table(s, d, "sections", "rec_id", "raw_text").dropDuplicates(["rec_id"]).select(F.col("rec_id").alias("id"), F.col("raw_text").alias("text"))


def _requests(s, d):
    b = table(s, d, "brackets", "rec_id", "deleted_text", "target_length").dropDuplicates(["rec_id"])
    return b.select(F.col("rec_id").cast("string").alias("request_id"), "deleted_text", "target_length")


def _plain(text, target):
    return text


def _own_texts(n):
    return n.select("book_id", "node_id", F.col("summary_text").alias("text")).where("text is not null")


def _brackets(s, d):
    n = checkpointed(_n(s, d))
    f = C.merged(C.fragments(n.drop("summary_text"), _inc(n)))
    return M.generate_brackets(f, _own_texts(n)).select("book_id", "node_id", "text", "outcome")


def _summaries(s, d):
    n = checkpointed(_n(s, d))
    return M.summaries(n.drop("summary_text"), _own_texts(n), M.Faulty)


def _tree(s, d):
    return M.build_tree(_sections(s, d), 700, 90)


def _replies(s, d):
    """Props of events as replies: most are objects, none has the lists asked for."""
    return table(s, d, "brackets", "rec_id", "bracket_text").dropDuplicates(["rec_id"]).select("rec_id", "bracket_text")


def _checked(s, d):
    """Texts of brackets put into replies of every form, and what the checks make of them."""
    t = F.coalesce("bracket_text", F.lit(""))
    q = F.to_json(F.struct(t.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(t.alias("t")))) - 6)  # the text as a JSON string
    reply = lambda a, b: F.concat(F.lit(a), q, F.lit(b))
    x = _replies(s, d).select(
        "rec_id", reply('{"summary": ', "}").alias("s"), reply('```json\n{"bracketText": ', "}\n```").alias("b"), reply('{"exclude":[{"nodeId":', ',"rationale":"r"}]}').alias("e"),
        reply('Here: {"dependencies":[{"nodeId":"n","rationale":"r"},{"nodeId":', ',"rationale":"r"}]}').alias("d"),
        reply('{"boundaries":[{"boundaryPageNumber":7,"suggestedTitle":', ',"confidence":0.9},{"boundaryPageNumber":60,"suggestedTitle":"x","confidence":0.2}]}').alias("w"),
        reply('{"children":[{"title":', ',"startOffset":0},{"title":"B","startOffset":40}]}').alias("c"),
    )
    return x.select(
        "rec_id", M.summary(F.col("s")).isNotNull().alias("summary"), F.length(M.bracket_text(F.col("b"))).alias("bracket"), F.size(M.exclusions(F.col("e"))).alias("excluded"),
        F.size(M.dependencies(F.col("d"))).alias("dependent"), F.size(M.boundaries(F.col("w"), F.lit(1), F.lit(50))).alias("boundaries"), M.children(F.col("c"))[0]["endOffset"].alias("first_end"),
    )


QUERIES = {
    "write_brackets": lambda s, d: M.write_brackets(_requests(s, d), M.Faulty, _plain).select("request_id", "text", "outcome"),
    "bracket_usage": lambda s, d: M.write_brackets(_requests(s, d), M.Faulty, _plain).groupBy("outcome").agg(F.count("*").alias("brackets"), F.sum("prompt_tokens").alias("prompt_tokens")),
    "bracket_prompts": lambda s, d: _requests(s, d).select("request_id", F.sha2(M.bracket_prompt(F.col("deleted_text"), F.col("target_length")), 256).alias("prompt")),
    "generate_brackets": _brackets,
    "summarize_nodes": _summaries,
    "suggest_exclusions": lambda s, d: M.suggest(_n(s, d)),
    "find_dependencies": lambda s, d: M.find_dependencies(_n(s, d)).select("book_id", "node_id", "leaf_id", "outcome"),
    "validate_replies": _checked,
    "decompose_replies": lambda s, d: M.complete(_sections(s, d).where("length(text) >= 200").select(F.col("id").cast("string").alias("request_id"), F.lit("decompose").alias("kind"), "text", F.lit(1500).alias("most"))).select("request_id", F.size(M.children(F.col("reply"))).alias("children")),
    "structure_windows": lambda s, d: M.detected_boundaries(S.window_texts(B.records(table(s, d, "blocks", *COLS)), 50), S.page_windows(table(s, d, "blocks", "book_id", "page_no"), 50)),
    "build_tree": _tree,
    "tree_leaves": lambda s, d: _tree(s, d).where("is_leaf").groupBy("id").agg(F.min("start_off").alias("lo"), F.max("end_off").alias("hi"), F.sum(F.col("end_off") - F.col("start_off")).alias("covered")),
}

_WS = "[ \\t\\n\\r\\f\\v]"
_LIST = f"list_filter(regexp_split_to_array({{0}}, '{_WS}+'), lambda w: w <> '')"
_TRIM = f"regexp_replace(regexp_replace({{0}}, '^{_WS}+', ''), '{_WS}+$', '')"


def _first(text: str, most: str) -> str:
    return f"array_to_string(list_slice({_LIST.format(text)}, 1, {most}), ' ')"


_LADDER = f"""r AS (SELECT DISTINCT CAST(rec_id AS VARCHAR) AS request_id, deleted_text AS t, length(deleted_text) AS n,
  CASE target_length WHEN 'one-line' THEN 30 WHEN 'short' THEN 110 WHEN 'medium' THEN 380 WHEN 'long' THEN 1100 END AS m FROM brackets),
x AS (SELECT *, nullif({_first('t', 'm')}, '') AS plain, array_to_string(list_transform(range(0, 6 * m), lambda i: 'word'), ' ') AS over FROM r WHERE t IS NOT NULL AND m IS NOT NULL),
y AS (SELECT *, CASE WHEN n % 5 IN (0, 1) THEN NULL WHEN n % 5 = 2 THEN over ELSE plain END AS one, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN over ELSE plain END AS two,
  n % 5 = 2 AS o1, n % 4 = 1 AS o2 FROM x),
z AS (SELECT *, CASE WHEN one IS NOT NULL AND NOT o1 THEN 'first' WHEN two IS NOT NULL AND NOT o2 THEN 'strict' WHEN two IS NOT NULL THEN 'cut' WHEN one IS NOT NULL THEN 'first cut' ELSE 'none' END AS outcome,
  array_to_string(list_transform(range(0, m), lambda i: 'word'), ' ') || '…' AS cut FROM y),
l AS (SELECT request_id, CASE outcome WHEN 'first' THEN one WHEN 'strict' THEN two WHEN 'none' THEN '[bracket unavailable]' ELSE cut END AS text, outcome, n FROM z
  UNION ALL SELECT request_id, '[bracket unavailable]', 'none', 0 FROM r WHERE t IS NULL OR m IS NULL)"""

_CLEAN = r"regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{FEFF}}]', '', 'g')"


def _summarized() -> str:
    """Bottom-up by depth: a text of n characters fails at first for n % 5 of 0 or 1 and then for n % 4 of 0."""
    asked = lambda t, most, fallback: f"CASE WHEN (length({t}) + 31) % 5 NOT IN (0, 1) OR (length({t}) + 31) % 4 <> 0 THEN {_first(t, most)} ELSE {fallback} END"
    outcome = lambda t: f"CASE WHEN (length({t}) + 31) % 5 NOT IN (0, 1) THEN 'first' WHEN (length({t}) + 31) % 4 <> 0 THEN 'second' ELSE 'placeholder' END"
    gone = "'[Summary unavailable after retry. Passage covers pages ' || coalesce(CAST(start_page AS VARCHAR), '?') || '–' || coalesce(CAST(end_page AS VARCHAR), '?') || '.]'"
    few = f"length({_TRIM.format('t')})"
    steps = [
        "lf AS (SELECT *, coalesce(summary_text, '') AS t, " + _CLEAN.format("coalesce(summary_text, '')") + " AS c FROM n WHERE is_leaf)",
        f"l99 AS (SELECT book_id, node_id, CASE WHEN {few} < 80 THEN coalesce(title, '') || ' — too little body text to summarize (' || {few} || ' characters).' ELSE {asked('c', '120', gone)} END AS summary, "
        f"CASE WHEN {few} < 80 THEN 'little' ELSE {outcome('c')} END AS outcome FROM lf)",
    ]
    last = "l99"
    for k in range(6, -1, -1):
        steps.append(
            f"b{k} AS (SELECT p.book_id, p.node_id, coalesce(c.title, '') AS title, x.summary, row_number() OVER (PARTITION BY p.book_id, p.node_id ORDER BY c.ord, c.node_id) AS i "
            f"FROM {last} x JOIN n c USING (book_id, node_id) JOIN n p ON p.book_id = c.book_id AND p.node_id = c.parent_id WHERE p.depth = {k} AND NOT p.is_leaf)"
        )
        steps.append(f"""g{k} AS (SELECT book_id, node_id, string_agg(i || '. "' || title || '" — ' || summary, chr(10) ORDER BY i) AS t0, 'This node covers: ' || string_agg(title, '; ' ORDER BY i) || '.' AS f FROM b{k} GROUP BY ALL)""")
        steps.append(f"t{k} AS (SELECT *, {_CLEAN.format('t0')} AS t FROM g{k})")
        steps.append(f"l{k} AS (SELECT * FROM {last} UNION ALL SELECT book_id, node_id, {asked('t', '250', 'f')}, {outcome('t')} FROM t{k})")
        last = f"l{k}"
    return f"WITH {_N}, " + ", ".join(steps) + f" SELECT book_id, node_id, summary, outcome FROM {last}"


_BUDGET = "CASE hint WHEN 'one-line' THEN 30 WHEN 'short' THEN 110 WHEN 'medium' THEN 380 ELSE 1100 END"

SQL = {
    "summarize_nodes": _summarized(),
    "generate_brackets": f"""WITH {_F}, {_M}, x AS (SELECT m.*, {_HINT} AS hint, n.summary_text AS t FROM m JOIN n USING (book_id, node_id) WHERE kind = 'bracket'),
y AS (SELECT *, nullif({_first(_CLEAN.format('t'), _BUDGET)}, '') AS w FROM x)
SELECT book_id, node_id, CASE WHEN t IS NULL THEN '[Editorial bracket unavailable. Original passage covered ' || format('{{:,}}', CAST(chars AS BIGINT)) || ' characters.]'
  WHEN w IS NULL THEN '[bracket unavailable]' ELSE w END AS text, CASE WHEN t IS NULL THEN 'missing' WHEN w IS NULL THEN 'none' ELSE 'first' END AS outcome FROM y""",
    "write_brackets": f"WITH {_LADDER} SELECT request_id, text, outcome FROM l",
    "bracket_usage": f"""WITH {_LADDER} SELECT outcome, count(*) AS brackets, CAST(sum(CASE WHEN n = 0 AND outcome = 'none' THEN 0 ELSE greatest(1, ceil(n / 4.0)) * CASE WHEN outcome = 'first' THEN 1 ELSE 2 END END) AS BIGINT) AS prompt_tokens
FROM l GROUP BY outcome""",
    "find_dependencies": f"""WITH {_N}, w AS (SELECT book_id, node_id, is_leaf, start_off, end_off, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-zà-ÿ]+'), lambda x: length(x) > 4) AS ws FROM n),
l AS (SELECT book_id, node_id AS leaf_id, start_off, ws, row_number() OVER (PARTITION BY book_id ORDER BY start_off, node_id) AS pos FROM w WHERE is_leaf AND start_off IS NOT NULL),
p AS (SELECT w.book_id, w.node_id, w.ws AS a, l.leaf_id, l.ws AS b, row_number() OVER (PARTITION BY w.book_id, w.node_id ORDER BY l.pos) AS k FROM w JOIN l ON l.book_id = w.book_id AND l.start_off >= w.end_off WHERE NOT w.is_leaf)
SELECT book_id, node_id, leaf_id, 'ok' AS outcome FROM p WHERE k <= 80 AND list_has_any(a, b)""",
    "suggest_exclusions": f"""WITH {_N} SELECT book_id, node_id, 'short' AS rationale, 'first' AS outcome FROM n WHERE parent_id IS NOT NULL AND depth = 1 AND coalesce(end_off - start_off, 0) % 3 = 0 AND coalesce(end_off - start_off, 0) >= 0""",
    "validate_replies": """SELECT DISTINCT rec_id, length(coalesce(bracket_text, '')) >= 20 AS summary,
  CASE WHEN length(coalesce(bracket_text, '')) >= 1 THEN length(regexp_replace(regexp_replace(bracket_text, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')) END AS bracket,
  CASE WHEN length(coalesce(bracket_text, '')) >= 1 THEN 1 ELSE NULL END AS excluded, CASE WHEN length(coalesce(bracket_text, '')) >= 1 THEN 2 ELSE NULL END AS dependent,
  CASE WHEN length(coalesce(bracket_text, '')) >= 1 THEN 1 ELSE NULL END AS boundaries, CASE WHEN length(coalesce(bracket_text, '')) BETWEEN 1 AND 160 THEN CAST(40 AS BIGINT) END AS first_end FROM brackets""",
    "decompose_replies": "SELECT DISTINCT CAST(rec_id AS VARCHAR) AS request_id, CAST(ceil(length(raw_text) / 1500.0) AS INT) AS children FROM sections WHERE length(raw_text) >= 200",
    "tree_leaves": "SELECT DISTINCT rec_id AS id, 0 AS lo, length(raw_text) AS hi, length(raw_text) AS covered FROM sections",
}
