"""Batch calls of a text model as a map over requests, the check of its replies, and what is done where it fails.

A provider turns a batch of requests into replies; one is made per Python worker. The extractive provider needs no
network and always gives the same reply. Every operator here is a fixed number of set-based steps: one call of all
requests, one more of those whose reply was no use, and a rule for the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import WORD_BUDGETS, WS_CHARS, lenient_json, let, named_terms, trimmed, truncate_words, word_count, wrap_untrusted
from quire.operators import tree as T
from quire.session import checkpointed

NODE = ["book_id", "node_id"]
REPLY = "request_id string, reply string, error string, prompt_tokens bigint, completion_tokens bigint"
#: Ends the kind of a request that is asked once more with a stricter instruction.
STRICT = "-strict"


class Provider(Protocol):
    """A batch of (request_id, kind, text, most) gives (request_id, reply, error); a kind may end in ``STRICT``."""

    def complete(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def _shared_words(text: str) -> list[str]:
    """Of the lines "id | title" behind the first those that share a longer word with it."""
    lines = [x.partition(" | ") for x in text.split("\n") if " | " in x]
    longer = lambda t: {w for w in re.split("[^a-zà-ÿ]+", t.lower()) if len(w) > 4}
    own = longer(lines[0][2]) if lines else set()
    return [i for i, _, title in lines[1:] if own & longer(title)]


class Extractive:
    """Summaries and brackets are first words; structure replies cut a text at every so many characters."""

    def reply(self, kind: str, text: str, most: int):
        if kind == "decompose":
            n = max(1, -(-len(text) // max(1, most)))
            kids = [{"title": f"Part {i + 1}", "startOffset": i * most, "endOffset": min(len(text), (i + 1) * most)} for i in range(n)]
            return "```json\n" + json.dumps({"children": kids}) + "\n```"
        if kind == "structure":
            found = []
            for page, first in re.findall(r"^--- page (\d+) ---\n([^\n]*)", text, re.M):
                head = first.split("  ")[0].strip()
                if 0 < len(head) < 60 and head[-1] not in ".!?…,;:":
                    found.append({"boundaryPageNumber": int(page), "suggestedTitle": head, "confidence": 0.8})
            return json.dumps({"boundaries": found}, ensure_ascii=False)
        if kind == "dependencies":
            return json.dumps({"dependencies": [{"nodeId": i, "rationale": "shares a word"} for i in _shared_words(text)]}, ensure_ascii=False)
        if kind == "suggest":
            nodes = [(i, int(n)) for i, d, n in re.findall(r"^- id=(\S+), depth=(\d+), .*?, (\d+) bytes — ", text, re.M) if d == "1"]
            return json.dumps({"exclude": [{"nodeId": i, "rationale": "short"} for i, n in nodes if n % 3 == 0], "summary": "by size"})
        body = re.sub(r"(?s).*<book_content>\n(.*)\n</book_content>.*", r"\1", text)
        words = " ".join(re.split("[ \\t\\n\\r\\f\\v]+", body.strip(" \t\n\r\f\v"))[:most])
        return json.dumps({"bracketText" if kind == "bracket" else "summary": words}, ensure_ascii=False)

    def complete(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples(index=False):
            x = self.reply(r.kind.removesuffix(STRICT), r.text or "", int(r.most))
            out.append((r.request_id, x, None))
        return pd.DataFrame(out, columns=["request_id", "reply", "error"])


class Faulty(Extractive):
    """Fails by rule, to show what is done then: by the length of a text, otherwise at the first and at the strict attempt."""

    def complete(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples(index=False):
            text, most, strict = r.text or "", int(r.most), r.kind.endswith(STRICT)
            kind = r.kind.removesuffix(STRICT)
            n = len(text)
            if n % 5 == 0 and not strict or n % 4 == 0 and strict:
                out.append((r.request_id, None, "network"))
            elif n % 5 == 1 and not strict:
                out.append((r.request_id, "no reply in the form asked for", None))
            elif kind == "bracket" and (n % 5 == 2 and not strict or n % 4 == 1 and strict):
                out.append((r.request_id, json.dumps({"bracketText": " ".join(["word"] * (6 * most))}), None))
            elif kind == "suggest" and strict:
                nodes = re.findall(r"^- id=(\S+), depth=1, .*?, (\d+) bytes — ", text, re.M)
                out.append((r.request_id, json.dumps({"exclude": [{"nodeId": i, "rationale": "more"} for i, k in nodes if int(k) % 3 != 1]}), None))
            else:
                out.append((r.request_id, self.reply(kind, text, most), None))
        return pd.DataFrame(out, columns=["request_id", "reply", "error"])


class Matching(Extractive):
    """For tests: the reply of the first rule whose pattern occurs in kind, request id or text; else the extractive one.

    ``rules``: (pattern, reply); a reply may be a function of (kind, text, most), an exception is raised, None is an error.
    """

    def __init__(self, rules: list[tuple[str, object]]):
        self.rules = rules

    def complete(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples(index=False):
            hit = next((x for p, x in self.rules if p in f"{r.kind}|{r.request_id}|{r.text}"), self.reply)
            if isinstance(hit, Exception):
                raise hit
            x = hit(r.kind.removesuffix(STRICT), r.text or "", int(r.most)) if callable(hit) else hit
            out.append((r.request_id, x, "unknown" if x is None else None))
        return pd.DataFrame(out, columns=["request_id", "reply", "error"])


def complete(requests: DataFrame, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(request_id, reply, error, prompt_tokens, completion_tokens) for (request_id, kind, text, most).

    A provider's failure is a row with its error; tokens that it doesn't report are estimated as a quarter of the
    characters. Requests that need no call are to be filtered before, as no filter passes through the map.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        tokens = lambda t: max(1, -(-len(t) // 4)) if isinstance(t, str) else 0
        for pdf in parts:
            try:
                out = provider.complete(pdf)
            except Exception as e:  # noqa: BLE001
                out = pd.DataFrame({"request_id": pdf["request_id"], "reply": None, "error": f"{type(e).__name__}: {e}"[:200]})
            if "prompt_tokens" not in out:
                asked = dict(zip(pdf["request_id"], pdf["text"], strict=True))
                out = out.assign(prompt_tokens=[tokens(asked.get(i)) for i in out["request_id"]], completion_tokens=[tokens(x) for x in out["reply"]])
            yield out[["request_id", "reply", "error", "prompt_tokens", "completion_tokens"]]

    return requests.select("request_id", "kind", "text", "most").mapInPandas(run, REPLY)


def replied(rows: DataFrame, kind: str, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """``rows`` of (request_id, text, most, ...) with their ``reply``; null where the text is null, which isn't sent, and for errors.

    All columns pass as Arrow, so that long texts needn't be joined to their replies again.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in parts:
            asked = b.select(["request_id", "text", "most"]).filter(pc.is_valid(b.column("text")))
            got: dict = {}
            if asked.num_rows:
                pdf = asked.to_pandas()
                pdf.insert(1, "kind", kind)
                try:
                    out = provider.complete(pdf)
                    got = dict(zip(out["request_id"], out["reply"], strict=True))
                except Exception:  # noqa: BLE001
                    got = {}
            replies = [x if isinstance(x := got.get(i), str) else None for i in b.column("request_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], names=[*b.schema.names, "reply"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("reply", StringType())]))


def asked_twice(requests: DataFrame, useful: Callable[[Column], Column], make: Callable[[], Provider]) -> DataFrame:
    """(request_id, first, second, prompt_tokens, completion_tokens): replies of all, and of those without use a second one.

    ``useful``: whether a reply is of use. Errors count as null replies; tokens are summed over both attempts.
    """
    req = checkpointed(requests.select("request_id", "kind", "text", "most"))
    one = checkpointed(complete(req, make))
    poor = one.where(F.col("error").isNotNull() | ~F.coalesce(useful(F.col("reply")), F.lit(False))).select("request_id")
    again = req.join(poor, "request_id", "left_semi").withColumn("kind", F.concat("kind", F.lit(STRICT)))
    two = complete(again, make).select("request_id", F.col("reply").alias("second"), F.col("prompt_tokens").alias("p2"), F.col("completion_tokens").alias("c2"))
    x = one.join(two, "request_id", "left")
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return checkpointed(x.select("request_id", F.col("reply").alias("first"), "second", total("prompt_tokens", "p2"), total("completion_tokens", "c2")))


# ------------------------------------------------------------------------------------------------ checks of replies
def _list(reply: Column, name: str, item: str, ok) -> Column:
    """The list ``name`` of a reply; null if it is missing or any of its items is invalid."""
    x = F.from_json(lenient_json(reply), f"{name} array<struct<{item}>>")[name]
    return let(x, lambda x: F.when(F.forall(x, lambda c: F.coalesce(ok(c), F.lit(False))), x))


def children(reply: Column) -> Column:
    """The children of a decomposition reply: array of (title, startOffset, endOffset); null if any of them is invalid.

    An end that is missing or not behind its start is filled by the next child's start (null for the last).
    """
    ok = lambda c: F.length(c["title"]).between(1, 160) & (c["startOffset"] >= 0) & (c["endOffset"].isNull() | (c["endOffset"] >= 1))
    x = _list(reply, "children", "title:string,startOffset:bigint,endOffset:bigint", ok)
    x = F.array_sort(x, lambda a, b: F.when(a["startOffset"] < b["startOffset"], -1).when(a["startOffset"] > b["startOffset"], 1).otherwise(0))

    def filled(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            end = F.when(c["endOffset"] > c["startOffset"], c["endOffset"]).otherwise(F.try_element_at(x, i + 2)["startOffset"])
            return F.struct(c["title"].alias("title"), c["startOffset"].alias("startOffset"), end.alias("endOffset"))

        return F.when(F.size(x) >= 1, F.transform(x, one))

    return let(x, filled)


def summary(reply: Column) -> Column:
    """The summary of a reply, of 20 characters at least."""
    x = F.get_json_object(lenient_json(reply), "$.summary")
    return F.when(F.length(x) >= 20, x)


def bracket_text(reply: Column) -> Column:
    """The trimmed text of a bracket reply, of one character at least."""
    x = F.get_json_object(lenient_json(reply), "$.bracketText")
    return F.when(F.length(x) >= 1, trimmed(x))


def exclusions(reply: Column) -> Column:
    """The nodes that a reply leaves out: array of (nodeId, rationale), maybe empty."""
    return _list(reply, "exclude", "nodeId:string,rationale:string", lambda c: (F.length(c["nodeId"]) >= 1) & c["rationale"].isNotNull())


def dependencies(reply: Column) -> Column:
    """The dependencies of a reply: array of (nodeId, rationale), maybe empty."""
    return _list(reply, "dependencies", "nodeId:string,rationale:string", lambda c: (F.length(c["nodeId"]) >= 1) & c["rationale"].isNotNull())


def boundaries(reply: Column, lo: Column, hi: Column) -> Column:
    """The boundaries of a structure reply inside the pages lo..hi; null if any of them is invalid."""
    x = F.from_json(lenient_json(reply), "boundaries array<struct<boundaryPageNumber:int,suggestedTitle:string,confidence:double>>")["boundaries"]
    ok = F.forall(x, lambda b: (b["boundaryPageNumber"] >= 1) & (F.length(b["suggestedTitle"]) >= 1) & b["confidence"].between(0, 1))
    return F.when(ok, F.filter(x, lambda b: b["boundaryPageNumber"].between(lo, hi)))


def detected_boundaries(windows: DataFrame, spans: DataFrame, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(book_id, page_no, title, confidence): boundaries that the model finds in windows of pages.

    ``windows`` is (book_id, win, text), ``spans`` (book_id, win, lo, hi). A failed window is asked once more; boundaries
    outside their window are dropped, and an invalid reply gives none.
    """
    key = F.concat_ws("\u0001", "book_id", "win")
    req = windows.select(key.alias("request_id"), F.lit("structure").alias("kind"), "text", F.lit(0).alias("most"))
    first = checkpointed(complete(req, make))
    again = complete(req.join(first.where("error is not null").select("request_id"), "request_id", "left_semi"), make)
    replies = first.where("error is null").unionByName(again.where("error is null"))
    x = spans.withColumn("request_id", key).join(replies, "request_id").select("book_id", F.explode(boundaries(F.col("reply"), F.col("lo"), F.col("hi"))).alias("b"))
    return x.select("book_id", F.col("b.boundaryPageNumber").alias("page_no"), F.col("b.suggestedTitle").alias("title"), F.col("b.confidence").alias("confidence"))


# ------------------------------------------------------------------------------------------------ brackets
# How often its budget of words a bracket may have before it is asked for again.
OVERSHOOT = 5


def bracket_prompt(text: Column, target: Column) -> Column:
    """What is asked for a bracket: the words it may have, terms to keep, and the passage as untrusted text."""
    return F.concat(F.lit("Length: "), target, F.lit("\nKeep: "), F.array_join(named_terms(text), "; "), F.lit("\n"), wrap_untrusted(text))


def write_brackets(requests: DataFrame, make: Callable[[], Provider] = Extractive, prompt=bracket_prompt) -> DataFrame:
    """(request_id, text, outcome, prompt_tokens, completion_tokens) of (request_id, deleted_text, target_length).

    A reply of over OVERSHOOT times its budget, an error or an invalid reply is asked for once more, strictly. A strict reply
    that is still over is cut to the budget (``cut``); where the strict attempt fails the first reply is cut to it (``first``),
    and without one there is a marker (``none``). A null passage or an unknown length has the marker at once.
    """
    words = F.create_map(*[F.lit(x) for kv in WORD_BUDGETS.items() for x in kv])
    r = requests.select("request_id", "deleted_text", "target_length", words[F.col("target_length")].alias("budget"))
    can = r.where("deleted_text is not null and budget is not null")
    budgets = can.select("request_id", "budget")
    req = can.select("request_id", F.lit("bracket").alias("kind"), prompt(F.col("deleted_text"), F.col("target_length")).alias("text"), F.col("budget").alias("most"))
    # whether a reply is within its limit needs its budget, so the first attempt is judged here
    req = checkpointed(req)
    one = checkpointed(complete(req, make).join(budgets, "request_id").select("*", bracket_text(F.col("reply")).alias("first")))
    over = lambda t: word_count(t) > OVERSHOOT * F.col("budget")
    fine = F.col("first").isNotNull() & ~F.coalesce(over(F.col("first")), F.lit(False))
    again = req.join(one.where(~fine).select("request_id"), "request_id", "left_semi").withColumn("kind", F.lit("bracket" + STRICT))
    two = complete(again, make).select("request_id", bracket_text(F.col("reply")).alias("second"), F.lit(True).alias("again"), F.col("prompt_tokens").alias("p2"), F.col("completion_tokens").alias("c2"))
    x = one.join(two, "request_id", "left")
    asked, second, first = F.col("again").isNotNull(), F.col("second"), F.col("first")
    outcome = F.when(~asked, "first").when(second.isNotNull() & ~over(second), "strict").when(second.isNotNull(), "cut").when(first.isNotNull(), "first cut").otherwise("none")
    text = (
        F.when(~asked, first).when(second.isNotNull() & ~over(second), second).when(second.isNotNull(), truncate_words(second, F.col("budget")))
        .when(first.isNotNull(), truncate_words(first, F.col("budget"))).otherwise("[bracket unavailable]")
    )
    tokens = [(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("prompt_tokens", "p2"), ("completion_tokens", "c2"))]
    done = x.select("request_id", text.alias("text"), outcome.alias("outcome"), *tokens)
    rest = r.where("deleted_text is null or budget is null")
    zero = F.lit(0).cast("long")
    return done.unionByName(rest.select("request_id", F.lit("[bracket unavailable]").alias("text"), F.lit("none").alias("outcome"), zero.alias("prompt_tokens"), zero.alias("completion_tokens")))


def generate_brackets(frags: DataFrame, texts: DataFrame, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(book_id, node_id, text, outcome): a bracket for every fragment that is left out.

    ``frags`` as of ``curation.merged``, ``texts`` is (book_id, node_id, text) of their passages; a fragment without text has a
    stand-in that tells its size.
    """
    key = F.concat_ws("\u0001", *NODE)
    b = checkpointed(frags.where("kind = 'bracket'").join(texts.groupBy(*NODE).agg(F.max("text").alias("passage")), NODE, "left").withColumn("request_id", key))
    w = write_brackets(b.where("passage is not null").select("request_id", F.col("passage").alias("deleted_text"), F.col("hint").alias("target_length")), make)
    missing = F.concat(F.lit("[Editorial bracket unavailable. Original passage covered "), F.format_number("chars", 0), F.lit(" characters.]"))
    return b.join(w, "request_id", "left").select(*NODE, F.coalesce("text", missing).alias("text"), F.coalesce("outcome", F.lit("missing")).alias("outcome"))


# ------------------------------------------------------------------------------------------------ summaries
# Characters below which a leaf has too little text, and words of summaries of leaves and inner nodes.
LITTLE, LEAF_WORDS, INNER_WORDS = 80, 120, 250


def summaries(nodes: DataFrame, texts: DataFrame, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(book_id, node_id, summary, outcome) of every node: leaves from their texts, inner nodes from their children, deepest first.

    A leaf of less than LITTLE characters isn't sent. What fails twice has a placeholder: a leaf names its pages, an inner
    node its children. One set-based step per depth over all books, whatever the depth; the lineage is cut after each.
    """
    n = checkpointed(nodes.select(*NODE, "parent_id", "ord", "depth", "is_leaf", F.coalesce("title", F.lit("")).alias("title"), "start_page", "end_page"))
    key = F.concat_ws("\u0001", *NODE)
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    t = texts.groupBy(*NODE).agg(F.max("text").alias("text"))
    leaf = n.where("is_leaf").join(t, NODE, "left").withColumn("text", F.coalesce("text", F.lit("")))
    size = F.length(trimmed(F.col("text")))
    little = F.concat("title", F.lit(" — too little body text to summarize ("), size.cast("string"), F.lit(" characters)."))
    short = leaf.where(size < LITTLE).select(*NODE, little.alias("summary"), F.lit("little").alias("outcome"))
    gone = F.concat(F.lit("[Summary unavailable after retry. Passage covers pages "), page("start_page"), F.lit("–"), page("end_page"), F.lit(".]"))

    def asked(rows: DataFrame, most: int, fallback: Column) -> DataFrame:
        rows = checkpointed(rows.withColumn("request_id", key))
        req = rows.select("request_id", F.lit("summary").alias("kind"), wrap_untrusted(F.col("text")).alias("text"), F.lit(most).alias("most"))
        got = asked_twice(req, lambda x: summary(x).isNotNull(), make)
        text = F.coalesce(summary(F.col("first")), summary(F.col("second")))
        outcome = F.when(summary(F.col("first")).isNotNull(), "first").when(text.isNotNull(), "second").otherwise("placeholder")
        return rows.join(got, "request_id").select(*NODE, F.coalesce(text, fallback).alias("summary"), outcome.alias("outcome"))

    out = checkpointed(short.unionByName(asked(leaf.where(size >= LITTLE), LEAF_WORDS, gone)))
    for depth in T._depths(n):
        here = n.where((F.col("depth") == depth) & ~F.col("is_leaf")).select(*NODE)
        kids = n.join(out, NODE).select("book_id", F.col("parent_id").alias("node_id"), F.struct("ord", F.col("node_id").alias("kid"), "title", "summary").alias("k"))
        k = kids.join(here, NODE, "left_semi").groupBy(*NODE).agg(F.sort_array(F.collect_list("k")).alias("k"))
        block = F.array_join(F.transform("k", lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x["title"], F.lit('" — '), x["summary"])), "\n")
        names = F.concat(F.lit("This node covers: "), F.array_join(F.transform("k", lambda x: x["title"]), "; "), F.lit("."))
        out = out.unionByName(checkpointed(asked(k.select(*NODE, block.alias("text"), names.alias("names")), INNER_WORDS, F.col("names"))))
    return out


# ------------------------------------------------------------------------------------------------ suggestions and dependencies
def suggest(nodes: DataFrame, keep: float = 0.6, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(book_id, node_id, rationale, outcome): nodes that the model would leave out, of those it was shown, never a root.

    One request per book lists its nodes in reading order with chains, sizes and summaries. Where less than half of the wanted
    size is left out (and less than 0.85 is to be kept) the book is asked once more, and the second reply counts if it has
    more entries. A book whose reply is an error or invalid has one row with a null node.
    """
    n = checkpointed(nodes.select(*NODE, "parent_id", "depth", "title", "start_off", "end_off", "is_leaf", "summary_text"))
    size = F.coalesce(F.col("end_off") - F.col("start_off"), F.lit(0))
    lines = T.listing(n).join(n.where("parent_id is not null").select(*NODE, "depth", size.alias("size"), "summary_text"), NODE)
    line = F.concat(
        F.lit("- id="), "node_id", F.lit(", depth="), F.col("depth").cast("string"), F.lit(', "'), F.regexp_replace("chain", r"\s+", " "), F.lit('", '), F.col("size").cast("string"),
        F.lit(" bytes — "), F.regexp_replace(F.coalesce("summary_text", F.lit("(no summary)")), r"\s+", " "),
    )
    total = n.where("is_leaf").groupBy("book_id").agg(F.sum(size).alias("total"))
    listed = lines.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    goal = F.floor((1 - keep) * F.coalesce("total", F.lit(0)) + 0.5).alias("goal")
    book = listed.join(total, "book_id", "left").select(F.col("book_id").alias("request_id"), F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("text"), goal)
    req = checkpointed(book.withColumn("kind", F.lit("suggest")).withColumn("most", F.col("goal").cast("int")))
    one = checkpointed(complete(req, make).select("request_id", exclusions(F.col("reply")).alias("x")))
    sizes = n.select(F.col("book_id").alias("request_id"), F.col("node_id").alias("nodeId"), size.alias("size"))
    cut = one.where("x is not null").select("request_id", F.explode_outer("x.nodeId").alias("nodeId")).join(sizes, ["request_id", "nodeId"], "left").groupBy("request_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("cut"))
    under = cut.join(req.select("request_id", "goal"), "request_id").where(F.lit(keep < 0.85) & ((F.col("cut") < F.col("goal") * 0.5) | (F.col("cut") == 0)))
    two = complete(req.join(under, "request_id", "left_semi").withColumn("kind", F.lit("suggest" + STRICT)), make).select("request_id", exclusions(F.col("reply")).alias("y"))
    x = one.join(two, "request_id", "left")
    more = F.coalesce(F.size("y") > F.size("x"), F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull()
    outcome = F.when(F.col("x").isNull(), "invalid").when(more, "second").otherwise("first")
    x = checkpointed(x.select("request_id", F.when(more, F.col("y")).otherwise(F.col("x")).alias("x"), outcome.alias("outcome")))
    known = n.where("parent_id is not null").select(F.col("book_id").alias("request_id"), F.col("node_id").alias("nodeId"))
    hits = x.where("x is not null").select("request_id", "outcome", F.explode("x").alias("e")).select("request_id", "outcome", "e.nodeId", "e.rationale").join(known, ["request_id", "nodeId"], "left_semi")
    none = x.where("x is null").select("request_id", F.lit(None).cast("string").alias("nodeId"), F.lit(None).cast("string").alias("rationale"), "outcome")
    return hits.unionByName(none).select(F.col("request_id").alias("book_id"), F.col("nodeId").alias("node_id"), "rationale", "outcome").distinct()


def find_dependencies(nodes: DataFrame, most: int = 80, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """(book_id, node_id, leaf_id, rationale, outcome): leaves behind an inner node that rely on it, of the first ``most`` behind it.

    Leaves that weren't offered are dropped; a node whose reply is an error or invalid has one row with a null leaf; a node
    with nothing behind it isn't asked.
    """
    t = nodes.select(*NODE, F.coalesce(F.regexp_replace("title", r"\s+", " "), F.lit("")).alias("title"))
    offered = checkpointed(T.downstream_leaves(nodes, most))
    lines = offered.join(t.select("book_id", F.col("node_id").alias("leaf_id"), F.col("title").alias("leaf")), ["book_id", "leaf_id"])
    block = lines.groupBy(*NODE).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("leaf_id", F.lit(" | "), "leaf").alias("line")))).alias("x"))
    text = F.concat("node_id", F.lit(" | "), "title", F.lit("\n"), F.array_join(F.transform("x", lambda y: y["line"]), "\n"))
    key = F.concat_ws("\u0001", *NODE)
    req = checkpointed(block.join(t, NODE).select(*NODE, key.alias("request_id"), F.lit("dependencies").alias("kind"), text.alias("text"), F.lit(0).alias("most")))
    got = complete(req, make).select("request_id", dependencies(F.col("reply")).alias("d"), F.when(F.col("error").isNotNull(), "error").when(dependencies(F.col("reply")).isNull(), "parse-error").otherwise("ok").alias("outcome"))
    x = checkpointed(req.select(*NODE, "request_id").join(got, "request_id").drop("request_id"))
    hits = x.where("outcome = 'ok'").select(*NODE, "outcome", F.explode("d").alias("e")).select(*NODE, F.col("e.nodeId").alias("leaf_id"), "e.rationale", "outcome")
    hits = hits.join(offered.select("book_id", "node_id", "leaf_id"), ["book_id", "node_id", "leaf_id"], "left_semi").distinct()
    none = F.lit(None).cast("string")
    return hits.unionByName(x.where("outcome <> 'ok'").select(*NODE, none.alias("leaf_id"), none.alias("rationale"), "outcome")).select(*NODE, "leaf_id", "rationale", "outcome")


def build_tree(items: DataFrame, least: int = T.MIN_CHARS, page: int = 2500, most_depth: int = T.DEPTH, seeds: DataFrame | None = None, fanout: int = 4, make: Callable[[], Provider] = Extractive) -> DataFrame:
    """Items of (id, text) decomposed level by level: (id, node_id, parent_id, ord, depth, title, start_off, end_off, start_page, end_page, is_leaf, source).

    A node that is deep, of few pages (``page`` characters each) or under ``least`` characters is a leaf. The others are sent to
    the model with their own part of the text, those with fewer than two children once more, strictly; a text of under 200
    characters isn't sent. The children are made contiguous, snapped to blank lines and capped (``tree.contiguous``), small
    ones merged (``tree.merged_in_order``); with fewer than two left the node is a forced leaf. Each level is one map over all
    items: a node's row holds its text, reply and children, and the next level cuts its texts out of it, so texts are never
    joined or shuffled. Leaves tile the text of their item. ``seeds``: (id, title, start_off, end_off) of a first level; an
    item whose only seed is its whole text has just a root of the source ``single-seed``. Ids are numbered level by level.
    """
    cols = ["id", "path", "parent", "depth", "title", "start_off", "end_off"]
    texts = items.select("id", F.coalesce("text", F.lit("")).alias("text"))
    start = [F.lit("000000").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("Book").alias("title"), F.lit(0).alias("start_off"), F.length("text").alias("end_off")]
    leaf = lambda df, source, flag=True: df.select(*cols, F.lit(flag).alias("is_leaf"), F.lit(source).alias("source"))
    origin = F.when(F.col("depth") == 0, "root").otherwise("toc" if seeds is not None else "llm-decomposed")

    def stops(depth: Column, lo: Column, hi: Column) -> Column:
        pages = F.floor((F.greatest(hi, lo + 1) - 1) / page) - F.floor(lo / page) + 1
        return (depth >= most_depth) | (pages <= T.LEAF_PAGES) | (hi - lo < least)

    def asked(rows: DataFrame, kind: str) -> DataFrame:
        """Rows of a level with the children of those that have a text (null: fewer than two), and their texts as long as they are needed."""
        size = F.col("end_off") - F.col("start_off")
        req = rows.select(*cols, "stop", F.concat_ws("\u0001", F.col("id").cast("string"), "path").alias("request_id"), "text", F.ceil(size / fanout).cast("int").alias("most"))
        got = replied(req, kind, make).select(*cols, "stop", "text", F.when(F.col("text").isNotNull(), children(F.col("reply"))).alias("c"))
        at = lambda x: (F.floor((F.col("start_off") + x) / page) + 1).cast("int")
        off = lambda x: F.col("start_off") + x

        def merged(x: Column) -> Column:
            entry = F.transform(x, lambda k: F.struct(at(k["start_off"]).alias("lo"), at(k["end_off"] - 1).alias("hi"), k["title"].alias("title"), off(k["start_off"]).alias("a"), off(k["end_off"]).alias("b")))
            return F.when(F.size(x) >= 2, T.merged_in_order(entry))

        many = F.coalesce(F.size("c") >= 2, F.lit(False))
        got = got.select(*cols, "stop", "text", (F.col("text").isNotNull() & ~many).alias("poor"), F.when(many, let(T.contiguous(F.col("c"), F.col("text")), merged)).alias("kids"))
        got = got.select(*cols, "stop", "text", "poor", F.when(F.size("kids") >= 2, F.col("kids")).alias("kids"))
        divided = F.exists("kids", lambda k: ~stops(F.col("depth") + 1, k["a"], k["b"]))
        return got.withColumn("text", F.when(F.col("poor") | divided, F.col("text")))

    def opened(rows: DataFrame) -> DataFrame:
        """A level with its own texts: whether a node stops, and null texts of those that aren't sent."""
        x = rows.withColumn("stop", stops(F.col("depth"), F.col("start_off"), F.col("end_off")))
        return x.withColumn("text", F.when(~F.col("stop") & (F.length(F.btrim("text", F.lit(WS_CHARS))) >= 200), F.col("text")))

    done, free = [], None
    if seeds is None:
        level = texts.select("id", *start, "text")
    else:
        free = texts = checkpointed(texts)
        root = checkpointed(texts.select("id", *start))
        x = checkpointed(seeds.join(texts.select("id", F.length("text").alias("n")), "id"))
        one = x.groupBy("id").agg(F.count("*").alias("k"), F.max(F.when((F.col("start_off") <= 0) & (F.col("end_off") >= F.col("n")), 1)).alias("whole"))
        single = one.where("k = 1 and whole = 1").select("id")
        good = x.join(single, "id", "left_anti").select("id", "title", F.col("start_off").cast("int"), F.col("end_off").cast("int"))
        done += [leaf(root.join(single, "id", "left_semi"), "single-seed"), leaf(root.join(good.select("id").distinct(), "id", "left_semi"), "root", False)]
        w = Window.partitionBy("id").orderBy("start_off")  # the seeds of one item
        first = good.withColumn("path", F.concat(F.lit("000000."), F.format_string("%06d", F.row_number().over(w) - 1)))
        first = first.select("id", "path", F.lit("000000").alias("parent"), F.lit(1).alias("depth"), "title", "start_off", "end_off")
        level = first.unionByName(root.join(x.select("id").distinct(), "id", "left_anti")).join(texts, "id")
        level = level.withColumn("text", F.col("text").substr(F.col("start_off") + 1, F.col("end_off") - F.col("start_off")))
    while True:
        tables = [checkpointed(asked(opened(level), "decompose"), frees=free)]
        free = None
        poor, more = tables[0].agg(F.max("poor"), F.max(F.col("kids").isNotNull())).first()
        if poor:
            again = tables[0].where("poor").drop("poor", "kids")
            tables = [tables[0].where("not poor"), checkpointed(asked(again, "decompose" + STRICT))]
            more = more or not tables[1].where("kids is not null").isEmpty()
        for t in tables:
            source = F.when(F.col("stop") | F.col("kids").isNotNull(), origin).otherwise("forced-leaf")
            done.append(t.select(*cols, F.col("kids").isNull().alias("is_leaf"), source.alias("source")))
        if not more:
            break
        inner = reduce(DataFrame.unionByName, [t.where("kids is not null").select("id", "path", "depth", F.col("start_off").alias("base"), "text", "kids") for t in tables])
        below = inner.select("id", "path", "depth", "base", "text", F.posexplode("kids").alias("k", "c"))
        a, b = F.col("c.a"), F.col("c.b")
        level = below.select(
            "id", F.concat("path", F.lit("."), F.format_string("%06d", "k")).alias("path"), F.col("path").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("c.title").alias("title"), a.alias("start_off"),
            b.alias("end_off"), F.when(~stops(F.col("depth") + 1, a, b), F.col("text").substr(a - F.col("base") + 1, b - a)).alias("text"),
        )
    order = Window.partitionBy("id").orderBy("depth", "path")  # nodes of one item
    named = checkpointed(reduce(DataFrame.unionByName, done).withColumn("node_id", F.format_string("node-%04d", F.row_number().over(order))))
    up = named.where("not is_leaf").select("id", F.col("path").alias("parent"), F.col("node_id").alias("parent_id"))
    out = named.join(up, ["id", "parent"], "left")
    ord_ = F.coalesce(F.regexp_extract("path", r"\.(\d+)$", 1).try_cast("int"), F.lit(0)).alias("ord")
    last = F.greatest("end_off", F.col("start_off") + 1) - 1
    number = lambda c, name: (F.floor(c / page) + 1).cast("int").alias(name)
    return out.select("id", "node_id", "parent_id", ord_, "depth", "title", "start_off", "end_off", number(F.col("start_off"), "start_page"), number(last, "end_page"), "is_leaf", "source")
