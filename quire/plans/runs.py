"""Queries over the state of runs, the store and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import runs as R
from quire.operators.intervals import latest
from quire.sources import store
from quire.tables import table


def _sections(s, d):
    return latest(table(s, d, "sections", "run_id", "section_id", "rec_id", "stored_at", "source", "confidence"), ["run_id", "section_id"], ["stored_at", "rec_id"], ["source", "confidence", "stored_at"])


def _phases(s, d):
    """Three phases of each section, with a status that its confidence and source give."""
    c = F.col("confidence")
    decompose = F.when(c.isNull(), "pending").when(c < 0.4, "error").when(c < 0.6, "in_flight").otherwise("done")
    summarise = F.when(F.col("source") == "fixed-window", "skipped").when(c < 0.5, "pending").otherwise("done")
    each = [F.struct(F.lit("structure").alias("phase"), F.lit("done").alias("status")), F.struct(F.lit("decompose").alias("phase"), decompose.alias("status")), F.struct(F.lit("summarise").alias("phase"), summarise.alias("status"))]
    x = _sections(s, d).select("run_id", "section_id", "stored_at", F.explode(F.array(*each)).alias("p"))
    return x.select("run_id", "section_id", "p.phase", "p.status", F.col("stored_at").alias("started_at"), F.lit(None).cast("string").alias("last_error"))


_STATUS = {"click": "in_progress", "view": "paused", "purchase": "done", "error": "errored", "signup": "cancelled"}


def _states(s, d):
    e = table(s, d, "events", "event_id", "ts", "user_id", "event_type")
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("phase"))


def _pins(s, d, newest):
    """Title and source of a section as pinned by its first version and as they are in its last; a null source isn't set."""
    x = table(s, d, "sections", "run_id", "section_id", "rec_id", "stored_at", "title", "source")
    k = F.struct("stored_at", "rec_id")
    v = x.groupBy("run_id", "section_id").agg((F.max_by if newest else F.min_by)(F.struct("title", "source"), k).alias("v"))
    each = F.array(F.struct(F.lit("title").alias("name"), F.col("v.title").alias("value")), F.struct(F.lit("source").alias("name"), F.col("v.source").alias("value")))
    y = v.select("run_id", "section_id", F.explode(each).alias("e")).where("e.value is not null")
    return y.select("run_id", F.concat_ws("/", "section_id", "e.name").alias("name"), "e.value")


def _ops(s, d):
    """Events as operations of their user's ledger: views and clicks reserve, purchases commit, errors cancel, signups raise the ceiling."""
    e = table(s, d, "events", "event_id", "user_id", "event_type", "value")
    op = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "signup", "ceiling").otherwise("reserve")
    size = F.when(F.col("event_type") == "signup", F.col("value") * 4).otherwise(F.col("value"))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("name"), size.alias("size"))


def _errors(s, d):
    e = table(s, d, "events", "event_id", "event_type", "props")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 400, 401, 403, 429, 500, 503)]), (F.col("event_id") % 7 + 1).cast("int"))
    kind = R.error_kind(status, F.col("props"))
    return e.select("event_id", kind.alias("kind"), R.retryable(kind).alias("again"))


def _waits(s, d):
    e = table(s, d, "events", "event_id", "value")
    i = F.col("event_id")
    left = lambda k: F.when(i % k != 0, i % k)
    return e.select("event_id", R.rate_wait(i, left(5), i + i % 90 - 20, left(7) * 400, F.when(i % 3 > 0, i + 40)).alias("wait"))


QUERIES = {
    "run_progress": lambda s, d: R.progress(_phases(s, d)),
    "in_flight_sections": lambda s, d: R.in_flight(_phases(s, d)),
    "sections_by_status": lambda s, d: R.with_status(_phases(s, d), "decompose", "error"),
    "phase_counters": lambda s, d: R.phase_counts(_phases(s, d)),
    "reap_orphans": lambda s, d: R.reaped(_phases(s, d), F.lit("2024-06-01 00:00:00").cast(_phases(s, d).schema["started_at"].dataType)).select("run_id", "section_id", "phase", "status", "last_error"),
    "current_runs": lambda s, d: R.current(_states(s, d)),
    "resumable_run": lambda s, d: R.resumable(R.current(_states(s, d))).select("run_id", "status", "phase"),
    "pinning_diff": lambda s, d: R.pinning(_pins(s, d, False), _pins(s, d, True)),
    "error_kinds": _errors,
    "rate_wait": _waits,
    "ledger_replay": lambda s, d: R.replayed(_ops(s, d), 150.0).select("run_id", "seq", "name", "outcome", F.round("reserved", 6).alias("reserved"), F.round("billed", 6).alias("billed"), "waiting"),
    "store_get": lambda s, d: store.get(table(s, d, "books"), book_id="bk-00-000000").select("book_id", "run_id", "title"),
    "store_by_run": lambda s, d: store.listed(table(s, d, "sections", "rec_id", "run_id", "section_id", "ord", "source").distinct(), ["ord", "rec_id"], source=["outline", "spine"]),
    "store_removed": lambda s, d: store.removed(table(s, d, "brackets", "rec_id", "run_id").distinct(), table(s, d, "books", "run_id", "book_format").where("book_format = 'epub'")),
    "store_upsert": lambda s, d: store.upserted(table(s, d, "nodes", "rec_id", "book_id", "node_id", "title", "stored_at").where("rec_id % 2 = 0"), table(s, d, "nodes", "rec_id", "book_id", "node_id", "title", "stored_at").where("rec_id % 2 = 1"), ["rec_id"], "stored_at").drop("stored_at"),
}

_LS = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, section_id ORDER BY stored_at DESC, rec_id DESC) AS rn FROM sections) WHERE rn = 1)"
_PH = f"""{_LS}, ph AS (SELECT run_id, section_id, stored_at, 'structure' AS phase, 'done' AS status FROM ls
UNION ALL SELECT run_id, section_id, stored_at, 'decompose', CASE WHEN confidence IS NULL THEN 'pending' WHEN confidence < 0.4 THEN 'error' WHEN confidence < 0.6 THEN 'in_flight' ELSE 'done' END FROM ls
UNION ALL SELECT run_id, section_id, stored_at, 'summarise', CASE WHEN source = 'fixed-window' THEN 'skipped' WHEN confidence < 0.5 THEN 'pending' ELSE 'done' END FROM ls)"""
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
_CUR = f"""cur AS (SELECT user_id AS run_id, arg_max({_CASE}, struct_pack(ts, event_id)) AS status, arg_max(event_type, struct_pack(ts, event_id)) AS phase, max(ts) AS updated_at, min(ts) AS created_at FROM events GROUP BY user_id)"""
_PIN = lambda way: f"SELECT run_id, section_id || '/' || name AS name, value FROM (SELECT run_id, section_id, unnest(['title', 'source']) AS name, unnest([{way}(coalesce(title, chr(0)), struct_pack(stored_at, rec_id)), {way}(coalesce(source, chr(0)), struct_pack(stored_at, rec_id))]) AS value FROM sections GROUP BY run_id, section_id) WHERE value <> chr(0)"

SQL = {
    "run_progress": f"WITH {_PH}, x AS (SELECT run_id, section_id, bool_and(status IN ('done', 'skipped')) AS d, bool_or(status = 'error') AS e FROM ph GROUP BY ALL) SELECT run_id, count(*) AS total, count(*) FILTER (d) AS done, count(*) FILTER (e) AS errored, count(*) FILTER (d) / count(*) AS ratio FROM x GROUP BY run_id",
    "in_flight_sections": f"WITH {_PH} SELECT DISTINCT run_id, section_id FROM ph WHERE status = 'in_flight'",
    "sections_by_status": f"WITH {_PH} SELECT DISTINCT run_id, section_id FROM ph WHERE phase = 'decompose' AND status = 'error'",
    "phase_counters": f"WITH {_PH} SELECT run_id, phase, status, count(*) AS sections FROM ph GROUP BY ALL",
    "reap_orphans": f"WITH {_PH}, x AS (SELECT *, status = 'in_flight' AND stored_at < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 5 MINUTE AS old FROM ph) SELECT run_id, section_id, phase, CASE WHEN old THEN 'pending' ELSE status END AS status, CASE WHEN old THEN 'orphan-reaped' END AS last_error FROM x",
    "current_runs": f"WITH {_CUR} SELECT * FROM cur",
    "resumable_run": f"WITH {_CUR} SELECT run_id, status, phase FROM cur WHERE status IN ('in_progress', 'paused') ORDER BY updated_at DESC, run_id DESC LIMIT 1",
    "pinning_diff": f"WITH a AS ({_PIN('arg_min')}), b AS ({_PIN('arg_max')}) SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.run_id = b.run_id AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.value IS DISTINCT FROM b.value",
    "error_kinds": """WITH x AS (SELECT event_id, [200, 400, 401, 403, 429, 500, 503][event_id % 7 + 1] AS st, coalesce(CAST(props AS VARCHAR), '') AS m FROM events),
y AS (SELECT event_id, CASE WHEN st IN (401, 403) THEN 'authentication' WHEN st = 429 THEN 'rate-limited' WHEN st = 400 AND regexp_matches(m, '(?i)context|too long|maximum') THEN 'context-overflow'
  WHEN st >= 500 THEN 'network' WHEN regexp_matches(m, '(?i)fetch failed|network|ECONN|ENOTFOUND') THEN 'network' ELSE 'unknown' END AS kind FROM x) SELECT event_id, kind, kind IN ('rate-limited', 'network', 'unknown') AS again FROM y""",
    "rate_wait": """WITH x AS (SELECT event_id AS i, CASE WHEN event_id % 5 <> 0 THEN event_id % 5 END AS r, CASE WHEN event_id % 7 <> 0 THEN event_id % 7 * 400 END AS t FROM events)
SELECT i AS event_id, greatest(0, CASE WHEN r < 2 THEN i % 90 - 20 ELSE 0 END, CASE WHEN t < 1000 AND i % 3 > 0 THEN 40 ELSE 0 END) AS wait FROM x""",
    "store_get": "SELECT book_id, run_id, title FROM books WHERE book_id = 'bk-00-000000'",
    "store_by_run": "SELECT DISTINCT rec_id, run_id, section_id, ord, source FROM sections WHERE source IN ('outline', 'spine')",
    "store_removed": "SELECT r.run_id, count(b.rec_id) AS rows FROM (SELECT DISTINCT run_id FROM books WHERE book_format = 'epub') r LEFT JOIN (SELECT DISTINCT rec_id, run_id FROM brackets) b USING (run_id) GROUP BY r.run_id",
    "store_upsert": "SELECT DISTINCT rec_id, book_id, node_id, title FROM nodes",
}
