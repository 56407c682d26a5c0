"""Queries over events, stored versions, calls, page layouts, model replies and EPUB files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quire.operators import events as E
from quire.operators.intervals import latest
from quire.sources import epub
from quire.streaming import windows as W
from quire.tables import table


def _ev(s, d):
    return table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _versions(s, d, newest):
    n = table(s, d, "nodes", "book_id", "node_id", "stored_at", "rec_id", "summary_text")
    k = F.struct("stored_at", "rec_id")
    return n.groupBy("book_id", "node_id").agg((F.max_by if newest else F.min_by)("summary_text", k).alias("summary"), F.count_distinct("rec_id").alias("n"))


def _calls(s, d):
    return table(s, d, "brackets", "rec_id", "book_id", "model", "deletion_index", "prompt_tokens", "completion_tokens", "produced_at").distinct()


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Ledger</dc:title><dc:creator>N. N.</dc:creator></metadata><manifest><item id="a" href="text/a.xhtml"/><item id="b" href="text/../text/b.xhtml"/><item id="c" href="missing.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="x"/><itemref idref="b"/><itemref idref="c"/></spine></package>')
        z.writestr("OEBPS/text/a.xhtml", "<html><head><title>t</title><script>var x = '</p>';</script></head><body><h1>First &amp; last</h1><p>One <b>bold</b> line.</p><div><p>Inner.</p></div><ul><li>item</li></ul></body></html>")
        z.writestr("OEBPS/text/b.xhtml", "<html><body><p>Figure 3. A map<p>unclosed<pre>code  here</pre><p class='footnote'>1 note</p><div> </div></body></html>")
    return out.getvalue()


def _files(s):
    return s.createDataFrame([("b/one.epub", bytearray(_epub())), ("b/bad.epub", bytearray(b"no zip")), ("b/none.epub", None)], "path string, content binary")


QUERIES = {
    "latest_activity": lambda s, d: E.latest_per_key(_ev(s, d), "user_id", ["event_type", "value"]),
    "activity_ring": lambda s, d: E.newest(_ev(s, d), 200).select("event_id", "user_id"),
    "node_event_fold": lambda s, d: E.folded(_ev(s, d), "user_id", "purchase").select("user_id", "first_type", "flagged", "n"),
    "events_since": lambda s, d: E.since(_ev(s, d), "2024-01-15 00:00:00").select("event_id"),
    "stale_keys": lambda s, d: E.stale(_ev(s, d), "user_id", "click").select("user_id", "event_id"),
    "state_switches": lambda s, d: E.switches(_ev(s, d), "user_id", "error"),
    "version_diff": lambda s, d: E.version_diff(_versions(s, d, False), _versions(s, d, True), ["book_id", "node_id"], "summary"),
    "ledger_totals": lambda s, d: E.token_ledger(_calls(s, d)),
    "call_estimate": lambda s, d: table(s, d, "brackets", "rec_id", "deleted_text", "prompt_tokens").distinct().select("rec_id", F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("deleted_text", F.lit(""))) / 4)).alias("estimate"), "prompt_tokens"),
    "budget_admission": lambda s, d: E.admitted(_calls(s, d).withColumn("size", F.col("prompt_tokens") + F.col("completion_tokens")), "book_id", ["produced_at", "rec_id"], "size", 3000).select("book_id", "rec_id", "size", "admitted"),
    "book_history": lambda s, d: table(s, d, "books", "book_id", "title", "created_at").join(latest(table(s, d, "sections"), ["book_id", "section_id"], ["stored_at", "rec_id"], ["title"]).groupBy("book_id").agg(F.count("*").alias("sections")), "book_id", "left").join(_calls(s, d).groupBy("book_id").agg(F.count("*").alias("brackets")), "book_id", "left").select("book_id", F.coalesce("title", "book_id").alias("name"), F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("brackets", F.lit(0)).alias("brackets")),
    "epub_export": lambda s, d: epub.rewritten(_files(s), s.createDataFrame([("b/one.epub", "b", "A short & plain bracket.")], "path string, spine_item_id string, bracket string")).select("path", "replaced", F.length("content").isNotNull().alias("written")),
    "epub_blocks": lambda s, d: epub.parse(_files(s)),
    "classify_html": lambda s, d: epub.parse(_files(s)).where("ok and text is not null").groupBy("tag", "classification").agg(F.count("*").alias("n")),
    "stream_tumbling": lambda s, d: W.run_to_table(W.tumbling(W.event_stream(s, d)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total")),
    "stream_sliding": lambda s, d: W.run_to_table(W.sliding(W.event_stream(s, d)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n"),
    "stream_session": lambda s, d: W.run_to_table(W.sessions(W.event_stream(s, d)), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "stream_latest": lambda s, d: W.run_to_table(W.latest(W.event_stream(s, d)), "complete"),
    "stream_dedup_late": lambda s, d: W.run_to_table(W.deduplicated(W.event_stream(s, d)), "append").select("event_id", "user_id", "event_type"),
}

_C = "c AS (SELECT DISTINCT rec_id, book_id, model, deletion_index, prompt_tokens, completion_tokens, produced_at FROM brackets)"

SQL = {
    "latest_activity": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "activity_ring": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "node_event_fold": "SELECT user_id, arg_min(event_type, struct_pack(ts, event_id)) AS first_type, coalesce(bool_or(event_type = 'purchase'), false) AS flagged, count(*) AS n FROM events GROUP BY user_id",
    "events_since": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
    "stale_keys": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE",
    "state_switches": "SELECT user_id, event_id, o AS \"on\" FROM (SELECT *, coalesce(event_type = 'error', false) AS o, coalesce(lag(coalesce(event_type = 'error', false)) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS w FROM events) WHERE o <> w",
    "version_diff": "WITH v AS (SELECT book_id, node_id, first_value(summary_text) OVER (PARTITION BY book_id, node_id ORDER BY stored_at, rec_id) AS a, first_value(summary_text) OVER (PARTITION BY book_id, node_id ORDER BY stored_at DESC, rec_id DESC) AS z FROM nodes) SELECT DISTINCT book_id, node_id, 'changed' AS change FROM v WHERE a IS DISTINCT FROM z",
    "ledger_totals": f"WITH {_C} SELECT model, count(*) AS calls, count(CASE WHEN prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL THEN 1 END) AS counted, coalesce(sum(prompt_tokens), 0) AS prompt, coalesce(sum(completion_tokens), 0) AS completion FROM c GROUP BY model",
    "call_estimate": "SELECT DISTINCT rec_id, greatest(1, CAST(ceil(length(coalesce(deleted_text, '')) / 4.0) AS BIGINT)) AS estimate, prompt_tokens FROM brackets",
    "budget_admission": f"""WITH RECURSIVE {_C}, o AS (SELECT book_id, rec_id, prompt_tokens + completion_tokens AS size, row_number() OVER (PARTITION BY book_id ORDER BY produced_at, rec_id) AS i FROM c WHERE prompt_tokens + completion_tokens IS NOT NULL),
f AS (SELECT book_id, rec_id, size, i, size <= 3000 AS admitted, CASE WHEN size <= 3000 THEN size ELSE 0 END AS used FROM o WHERE i = 1
UNION ALL SELECT o.book_id, o.rec_id, o.size, o.i, f.used + o.size <= 3000, f.used + CASE WHEN f.used + o.size <= 3000 THEN o.size ELSE 0 END FROM f JOIN o ON o.book_id = f.book_id AND o.i = f.i + 1) SELECT book_id, rec_id, size, admitted FROM f""",
    "book_history": f"WITH {_C} SELECT b.book_id, coalesce(b.title, b.book_id) AS name, coalesce(s.n, 0) AS sections, coalesce(k.n, 0) AS brackets FROM books b LEFT JOIN (SELECT book_id, count(DISTINCT section_id) AS n FROM sections GROUP BY book_id) s USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n FROM c GROUP BY book_id) k USING (book_id)",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY ALL",
    "stream_session": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, g""",
    "stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "stream_dedup_late": "SELECT event_id, user_id, event_type FROM events",
}
