"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.tables import table

WS = "[ \\t\\n\\r\\f\\v]"
_WORDS = f"list_filter(regexp_split_to_array({{0}}, '{WS}+'), lambda w: w <> '')"
_TRIM = f"regexp_replace(regexp_replace({{0}}, '^{WS}+', ''), '{WS}+$', '')"
_MD5 = "md5({0})"


def _docs(s, d, **cols):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", *[c.alias(n) for n, c in cols.items()])


def _T():
    return F.col("text")


def _durations(s, d):
    """Durations in all forms, some of them none, from the numbers of events."""
    i, n = F.col("event_id"), (F.col("event_id") % 977).cast("string")
    form = F.when(i % 6 == 0, F.concat(n, F.lit("s"))).when(i % 6 == 1, F.concat(n, F.lit("m"), (i % 60).cast("string"), F.lit("s"))).when(i % 6 == 2, F.concat(n, F.lit("ms")))
    form = form.when(i % 6 == 3, F.concat(n, F.lit(".5"))).when(i % 6 == 4, F.concat(n, F.lit(" h"))).otherwise(F.concat(F.lit("1h"), n, F.lit("m")))
    return table(s, d, "events", "event_id").select("event_id", F.when(i % 50 > 0, form).alias("raw"))


def _replies(s, d):
    """The props of events as a model might wrap them."""
    i, p = F.col("event_id"), F.col("props")
    raw = F.when(i % 5 == 0, p).when(i % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(i % 5 == 3, F.lit("null")).otherwise(p.substr(F.lit(1), F.length(p) - 1))
    return table(s, d, "events", "event_id", "props").select(F.col("event_id").alias("id"), raw.alias("raw"))


_DUR = """(SELECT event_id, CASE WHEN event_id % 50 > 0 THEN CASE event_id % 6 WHEN 0 THEN event_id % 977 || 's' WHEN 1 THEN event_id % 977 || 'm' || event_id % 60 || 's' WHEN 2 THEN event_id % 977 || 'ms'
WHEN 3 THEN event_id % 977 || '.5' WHEN 4 THEN event_id % 977 || ' h' ELSE '1h' || event_id % 977 || 'm' END END AS raw FROM events)"""
_RAW = """(SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN 'null' ELSE props[1:length(props) - 1] END AS raw FROM events)"""


QUERIES = {
    "token_estimate": lambda s, d: _docs(s, d, tokens=T.token_estimate(_T())),
    "word_count": lambda s, d: _docs(s, d, words=T.word_count(_T())),
    "truncate_words": lambda s, d: table(s, d, "brackets", "rec_id", "bracket_text").distinct().select("rec_id", T.truncate_words(F.col("bracket_text"), 30).alias("short")),
    "strip_control": lambda s, d: _docs(s, d, clean=F.md5(T.strip_control(_T())), dropped=F.length(_T()) - F.length(T.strip_control(_T()))),
    "wrap_untrusted": lambda s, d: _docs(s, d, wrapped=F.md5(T.wrap_untrusted(_T()))),
    "length_hint": lambda s, d: table(s, d, "nodes", "rec_id", "start_off", "end_off").distinct().select("rec_id", T.length_hint(F.col("end_off") - F.col("start_off")).alias("hint")),
    "offset_annotate": lambda s, d: _docs(s, d, marked=F.md5(T.offset_annotate(_T())), n=F.length(T.offset_annotate(_T()))),
    "sample_sentences": lambda s, d: _docs(s, d, sentences=F.array_join(T.sample_sentences(_T(), 5), "|")),
    "named_terms": lambda s, d: _docs(s, d, terms=F.array_join(T.named_terms(_T()), "|")),
    "context_before": lambda s, d: _docs(s, d, before=T.context_before(_T(), F.floor(F.length(_T()) / 2).cast("int"))),
    "context_after": lambda s, d: _docs(s, d, after=T.context_after(_T(), F.floor(F.length(_T()) / 2).cast("int"))),
    "context_around": lambda s, d: _docs(s, d, x=T.around(_T(), F.lit(300), F.lit(420))).select("doc_id", "x.before", "x.after"),
    "section_slug": lambda s, d: table(s, d, "sections", "rec_id", "ord", "title").distinct().select("rec_id", T.section_slug(F.col("ord") + 1, F.col("title")).alias("slug")),
    "preview_clip": lambda s, d: _docs(s, d, clip=T.preview(_T())),
    "sha_pins": lambda s, d: _docs(s, d, pin=F.sha2(_T(), 256)),
    "file_names": lambda s, d: table(s, d, "books", "book_id", "title").select("book_id", T.file_name(F.col("title")).alias("file")),
    "bracket_html": lambda s, d: table(s, d, "brackets", "rec_id", "bracket_text").distinct().select("rec_id", T.paragraphs_html(F.col("bracket_text")).alias("html")),
    "wrapped_lines": lambda s, d: table(s, d, "brackets", "rec_id", "bracket_text").distinct().select("rec_id", F.posexplode(T.wrapped(F.col("bracket_text"), 60)).alias("line_no", "line")),
    "paginated_lines": lambda s, d: table(s, d, "brackets", "rec_id", "bracket_text").distinct().select("rec_id", F.posexplode(T.wrapped(F.col("bracket_text"), 60)).alias("n", "line")).groupBy("rec_id", F.floor(F.col("n") / 8).alias("page")).agg(F.count("*").alias("lines")),
    "parse_duration": lambda s, d: _durations(s, d).select("event_id", T.duration_ms(F.col("raw")).alias("ms")),
    "lenient_json": lambda s, d: _replies(s, d).select("id", T.lenient_json(F.col("raw")).isNotNull().alias("ok"), F.length(T.lenient_json(F.col("raw"))).alias("n")),
    "backoff_schedule": lambda s, d: table(s, d, "events", "event_id").select("event_id", F.least(F.lit(60000.0), F.least(F.lit(60000.0), 500.0 * F.pow(F.lit(2.0), F.col("event_id") % 21)) * 1.125).alias("wait_ms")),
    "event_props": lambda s, d: table(s, d, "events", "event_id", "props").select("event_id", F.size(F.json_object_keys("props")).alias("keys"), T.lenient_json(F.col("props")).isNotNull().alias("ok")),
}

_PARA = f"regexp_split_to_array({{0}}, '\\n{WS}*\\n')"
_HEAD = f"regexp_replace(text[1:CAST(floor(length(text) / 2) AS INT)], '{WS}+$', '')"
_TAIL = f"regexp_replace(text[CAST(floor(length(text) / 2) AS INT) + 1:], '^{WS}+', '')"
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])" + WS + "+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + _TRIM.format("x") + "), lambda x: length(x) BETWEEN 25 AND 240)"

_WRAP = f"""
WITH RECURSIVE b AS (SELECT DISTINCT rec_id, bracket_text FROM brackets WHERE bracket_text IS NOT NULL),
w AS (SELECT rec_id, {_WORDS.format('bracket_text')} AS ws FROM b),
r AS (
  SELECT rec_id, ws, 1 AS i, CAST(0 AS INT) AS line_no, ws[1] AS line, false AS done FROM w WHERE len(ws) > 0
  UNION ALL
  SELECT rec_id, ws, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 60 THEN line_no ELSE line_no + 1 END,
    CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 60 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END, false FROM r WHERE i < len(ws)),
l AS (SELECT rec_id, line_no, arg_max(line, i) AS line FROM r GROUP BY rec_id, line_no)"""



def _FIRST(pattern: str, most: int, bounded: bool = True) -> str:
    """The first distinct matches in order of appearance."""
    p = f"\\b{pattern}\\b" if bounded else pattern
    found = f"regexp_extract_all(text, '{p}')"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)[1:{most}]"


SQL = {
    "token_estimate": "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS INT)) + length(text) * 0 AS tokens FROM documents",
    "word_count": f"SELECT doc_id, len({_WORDS.format('text')}) AS words FROM documents",
    "truncate_words": f"""SELECT DISTINCT rec_id, CASE WHEN len({_WORDS.format('bracket_text')}) <= 30 THEN {_TRIM.format('bracket_text')}
ELSE regexp_replace(array_to_string({_WORDS.format('bracket_text')}[1:30], ' '), '[,;: ]+$', '') || '…' END AS short FROM brackets""",
    "strip_control": r"""SELECT doc_id, md5(c) AS clean, length(text) - length(c) AS dropped FROM (SELECT doc_id, text, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g') AS c FROM documents)""",
    "wrap_untrusted": r"""SELECT doc_id, md5('<book_content>' || chr(10) || c || chr(10) || '</book_content>') AS wrapped FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '(?i)</book_content', '<\\/book_content', 'g') AS c FROM documents)""",
    "length_hint": "SELECT rec_id, CASE WHEN n <= 1500 THEN 'one-line' WHEN n <= 7500 THEN 'short' WHEN n <= 30000 THEN 'medium' WHEN n IS NOT NULL THEN 'long' END AS hint FROM (SELECT DISTINCT rec_id, end_off - start_off AS n FROM nodes)",
    "offset_annotate": """SELECT doc_id, md5(m) AS marked, length(m) AS n FROM (SELECT doc_id, CASE WHEN length(text) < 1000 THEN text ELSE
(SELECT string_agg('[OFFSET=' || i || ']' || text[CAST(i AS INT) + 1:CAST(i AS INT) + 1000], '' ORDER BY i) FROM range(0, length(text), 1000) t(i)) END AS m FROM documents)""",
    "sample_sentences": f"""SELECT doc_id, array_to_string(CASE WHEN len(p) <= 5 THEN p ELSE list_transform(range(0, 5), lambda i: p[CAST(floor((i + 0.5) * len(p) / 5) AS INT) + 1]) END, '|') AS sentences
FROM (SELECT doc_id, {_SENT} AS p FROM documents)""",
    "context_before": f"SELECT doc_id, {_TRIM.format('right(' + _TRIM.format(_PARA.format(_HEAD) + '[-1]') + ', 600)')} AS before FROM documents",
    "context_after": f"SELECT doc_id, {_TRIM.format('left(' + _TRIM.format(_PARA.format(_TAIL) + '[1]') + ', 600)')} AS after FROM documents",
    "context_around": "SELECT doc_id, text[61:300] AS before, text[421:660] AS after FROM documents",
    "section_slug": """SELECT DISTINCT rec_id, printf('sec-%03d-', ord + 1) || CASE WHEN g = '' THEN 'untitled' ELSE left(g, 40) END AS slug
FROM (SELECT rec_id, ord, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS g FROM sections)""",
    "preview_clip": "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 400) || '…[' || (length(text) - 400) || ' more chars]' ELSE text END AS clip FROM documents",
    "sha_pins": "SELECT doc_id, sha256(text) AS pin FROM documents",
    "file_names": r"SELECT book_id, left(regexp_replace(coalesce(title, 'book'), '[\\/\x00-\x1f]', '_', 'g'), 80) || '-short' AS file FROM books",
    "bracket_html": f"""SELECT rec_id, CASE WHEN coalesce(len(p), 0) < 1 THEN '<p>[omitted]</p>' ELSE array_to_string(list_transform(p, lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>'), chr(10)) END AS html
FROM (SELECT DISTINCT rec_id, list_filter(list_transform({_PARA.format('bracket_text')}, lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS p FROM brackets)""",
    "wrapped_lines": _WRAP + " SELECT rec_id, line_no, line FROM l",
    "paginated_lines": _WRAP + " SELECT rec_id, line_no // 8 AS page, count(*) AS lines FROM l GROUP BY rec_id, line_no // 8",
    "parse_duration": f"""SELECT event_id, CASE WHEN regexp_matches(raw, '^([0-9]+(\\.[0-9]+)?(ms|s|m|h))+$') THEN
list_sum(list_transform(regexp_extract_all(raw, '[0-9.]+(ms|s|m|h)'), lambda p: CAST(regexp_extract(p, '^[0-9.]+') AS DOUBLE) * CASE WHEN p LIKE '%ms' THEN 1 WHEN p LIKE '%h' THEN 3600000 WHEN p LIKE '%m' THEN 60000 ELSE 1000 END))
WHEN regexp_matches(raw, '^[0-9]+(\\.[0-9]+)?$') THEN 1000.0 * TRY_CAST(raw AS DOUBLE) END AS ms FROM {_DUR}""",
    "named_terms": f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_concat({_FIRST('[A-Z][a-z]+(?:' + WS + '+[A-Z][a-z]+)*', 20)}, list_concat({_FIRST('[0-9]{4}', 10)}, {_FIRST('"[^"' + chr(10) + ']{1,160}"', 5, False)})), '|') END AS terms FROM documents""",
    "backoff_schedule": "SELECT event_id, least(60000.0, least(60000.0, 500.0 * pow(2.0, event_id % 21)) * 1.125) AS wait_ms FROM events",
    "event_props": "SELECT event_id, len(json_keys(props)) AS keys, json_valid(props) AND props <> 'null' AS ok FROM events",
    "lenient_json": f"""WITH v AS (SELECT id, raw, CASE WHEN contains(raw, '```') AND regexp_extract(raw, '(?is)```(?:json)?\\s*(.*?)```', 1) <> '' THEN {_TRIM.format("regexp_extract(raw, '(?is)```(?:json)?" + chr(92) + "s*(.*?)```', 1)")} ELSE {_TRIM.format('raw')} END AS inn FROM {_RAW}),
c AS (SELECT id, unnest([raw, inn, inn[instr(inn, '{{'):length(inn) - instr(reverse(inn), '}}') + 1], inn[instr(inn, '['):length(inn) - instr(reverse(inn), ']') + 1]]) AS t, unnest([1, 2, 3, 4]) AS k,
 unnest([true, true, contains(inn, '{{') AND contains(inn, '}}') AND length(inn) - instr(reverse(inn), '}}') + 1 > instr(inn, '{{'), contains(inn, '[') AND contains(inn, ']') AND length(inn) - instr(reverse(inn), ']') + 1 > instr(inn, '[')]) AS can FROM v),
g AS (SELECT id, arg_min(t, k) AS t FROM c WHERE can AND t <> '' AND {_TRIM.format('t')} <> 'null' AND json_valid(t) GROUP BY id)
SELECT v.id, g.t IS NOT NULL AS ok, length(g.t) AS n FROM v LEFT JOIN g ON v.id = g.id""",
}
