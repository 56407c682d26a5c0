"""Calls of a model and what is done where it fails; decomposition of texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import model as M
from quire.operators import tree as T

TEXT = "In 1842 the Harbour Council met. " * 30


def bracket(words):
    return json.dumps({"bracketText": " ".join(["w"] * words)})


def asked(frame, rules, target="one-line", text=TEXT):
    df = frame([("r1", text, target)], "request_id string, deleted_text string, target_length string")
    return [(r.text, r.outcome) for r in M.write_brackets(df, lambda: M.Matching(rules)).collect()][0]


@pytest.mark.parametrize(
    "rules,outcome,words",
    [
        ([("bracket", bracket(20))], "first", 20), ([("bracket", bracket(150))], "first", 150), ([("bracket-strict", bracket(12)), ("bracket", bracket(151))], "strict", 12),
        ([("bracket", bracket(400))], "cut", 30), ([("bracket-strict", None), ("bracket", bracket(200))], "first cut", 30), ([("bracket-strict", bracket(9)), ("bracket", "no json")], "strict", 9),
        ([("bracket", None)], "none", 2), ([("bracket", RuntimeError("down"))], "none", 2),
    ],
)
def test_bracket_ladder(frame, rules, outcome, words):
    text, got = asked(frame, rules)
    assert got == outcome and len(text.split()) == words
    assert text.endswith("…") == ("cut" in outcome)


def test_brackets_that_cannot_be_asked(frame):
    assert asked(frame, [], text=None) == ("[bracket unavailable]", "none") and asked(frame, [], target=None) == ("[bracket unavailable]", "none")


NODES = "book_id string, node_id string, parent_id string, ord int, depth int, is_leaf boolean, title string, start_off bigint, end_off bigint, start_page int, end_page int, summary_text string"
ROWS = [("b", "root", None, 0, 0, False, "Book", 0, 4000, 1, 20, None), ("b", "A", "root", 0, 1, False, "Harbours", 0, 2000, 1, 10, None), ("b", "B", "root", 1, 1, True, "Ferries", 2000, 4000, 11, None, None)]
ROWS += [("b", "a1", "A", 0, 2, True, "North harbours", 0, 1000, 1, 5, None), ("b", "a2", "A", 1, 2, True, "Ships", 1000, 2000, 6, 10, None)]


def test_summaries_and_placeholders(frame):
    n = frame(ROWS, NODES)
    texts = frame([("b", "a1", TEXT), ("b", "a2", "  short  "), ("b", "B", TEXT + "bad")], "book_id string, node_id string, text string")
    good = json.dumps({"summary": "A summary of twenty characters or more."})
    rules = [("bad", None), ("North harbours", "{}"), ("Ships", "{}"), ("summary", good)]
    got = {r.node_id: (r.summary, r.outcome) for r in M.summaries(n, texts, lambda: M.Matching(rules)).collect()}
    assert got["a1"] == ("A summary of twenty characters or more.", "first")
    assert got["a2"] == ("Ships — too little body text to summarize (5 characters).", "little")
    assert got["B"] == ("[Summary unavailable after retry. Passage covers pages 11–?.]", "placeholder")
    assert got["A"] == ("This node covers: North harbours; Ships.", "placeholder") and got["root"][1] == "placeholder"


def reply(*ids):
    return json.dumps({"exclude": [{"nodeId": i, "rationale": "r"} for i in ids]})


@pytest.mark.parametrize(
    "rules,keep,want,outcome",
    [
        ([("suggest", reply("A", "root", "nope"))], 0.5, {"A"}, "first"), ([("suggest-strict", reply("a1", "a2")), ("suggest", reply("a1"))], 0.4, {"a1", "a2"}, "second"),
        ([("suggest-strict", reply("B")), ("suggest", reply("a1"))], 0.2, {"a1"}, "first"), ([("suggest-strict", reply("B")), ("suggest", reply())], 0.5, {"B"}, "second"),
        ([("suggest-strict", reply("B")), ("suggest", reply())], 0.9, set(), None), ([("suggest", "nothing")], 0.5, {None}, "invalid"),
    ],
)
def test_suggestions(frame, rules, keep, want, outcome):
    got = M.suggest(frame(ROWS, NODES), keep, lambda: M.Matching(rules)).collect()
    assert {r.node_id for r in got} == want and {r.outcome for r in got} <= {outcome}


def test_dependencies(frame):
    n = frame(ROWS, NODES)
    rules = [("dependencies", json.dumps({"dependencies": [{"nodeId": "B", "rationale": "uses it"}, {"nodeId": "a1", "rationale": "before"}]}))]
    got = M.find_dependencies(n, make=lambda: M.Matching(rules)).collect()
    assert [(r.node_id, r.leaf_id, r.outcome) for r in got] == [("A", "B", "ok")]
    assert [(r.leaf_id, r.outcome) for r in M.find_dependencies(n, make=lambda: M.Matching([("dependencies", "?")])).collect()] == [(None, "parse-error")]
    assert [r.outcome for r in M.find_dependencies(n, make=lambda: M.Matching([("dependencies", None)])).collect()] == ["error"]


def test_usage_is_summed_over_attempts(frame):
    df = frame([("r", "x" * 400, "short")], "request_id string, deleted_text string, target_length string")
    one, two = (M.write_brackets(df, lambda x=x: M.Matching([("bracket", x)]), lambda t, _: t).first() for x in (bracket(5), "no"))
    assert (one.prompt_tokens, two.prompt_tokens) == (100, 200)


def rows(df):
    return {r.node_id: r for r in df.collect()}


def test_tree_tiles_and_ids(frame):
    text = "\n\n".join(f"Paragraph {i}. " + "It went on for a while. " * 30 for i in range(60))
    got = rows(M.build_tree(frame([(1, text), (2, None), (3, "tiny")], "id int, text string").where("id = 1"), 2000, 500))
    leaves = sorted((r.start_off, r.end_off) for r in got.values() if r.is_leaf)
    assert leaves[0][0] == 0 and leaves[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False))
    assert sorted(got) == [f"node-{i:04d}" for i in range(1, len(got) + 1)] and got["node-0001"].parent_id is None
    assert all(got[r.parent_id].start_off <= r.start_off and r.end_off <= got[r.parent_id].end_off and r.depth == got[r.parent_id].depth + 1 for r in got.values() if r.parent_id)
    assert all(text[r.end_off - 2 : r.end_off] == "\n\n" for r in got.values() if r.end_off < len(text))
    assert all(sum(1 for c in got.values() if c.parent_id == r.node_id) in range(2, T.MAX_CHILDREN + 1) for r in got.values() if not r.is_leaf)


def test_forced_leaves_retry_and_seeds(frame):
    text = "It went on for a while. " * 800
    items = frame([(1, text)], "id int, text string")
    kids = json.dumps({"children": [{"title": "One", "startOffset": 0}, {"title": "Two", "startOffset": 9000}]})
    got = rows(M.build_tree(items, 1000, 500, 1, make=lambda: M.Matching([("decompose-strict", kids), ("decompose", "{}")])))
    assert [(r.title, r.source, r.is_leaf) for _, r in sorted(got.items())] == [("Book", "root", False), ("One", "llm-decomposed", True), ("Two", "llm-decomposed", True)]
    got = rows(M.build_tree(items, 1000, 500, make=lambda: M.Matching([("decompose", None)])))
    assert [(r.source, r.is_leaf) for r in got.values()] == [("forced-leaf", True)]
    seed = frame([(1, "Only", 0, len(text))], "id int, title string, start_off int, end_off int")
    assert [r.source for r in M.build_tree(items, 1000, 500, seeds=seed).collect()] == ["single-seed"]
    two = frame([(1, "A", 0, 9000), (1, "B", 9000, len(text))], "id int, title string, start_off int, end_off int")
    assert {(r.title, r.source) for r in M.build_tree(items, 10**6, 500, seeds=two).collect()} == {("Book", "root"), ("A", "toc"), ("B", "toc")}


def test_a_reply_is_parsed_once_for_all_its_children(frame):
    """Named inside a lambda, the parsed reply was made again for every child."""
    reply = '{"children":[{"title":"b","startOffset":5},{"title":"a","startOffset":0},{"title":"c","startOffset":9,"endOffset":12}]}'
    x = frame([(reply,), (None,), ("{}",)], "r string").select(M.children(F.col("r")).alias("c"))
    assert [r.c and [tuple(k) for k in r.c] for r in x.collect()] == [[("a", 0, 5), ("b", 5, 9), ("c", 9, 12)], None, None]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_texts_of_a_tree_are_neither_joined_nor_shuffled(frame, monkeypatch):
    """Each level used to join the whole texts to its nodes, and their parts to the replies and again to their children."""
    plans, old = [], M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df, frees=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df, frees))
    text = "\n\n".join(f"Paragraph {i}. " + "It went on for a while. " * 30 for i in range(60))
    got = rows(M.build_tree(frame([(1, text)], "id int, text string"), 2000, 500, make=M.Faulty))
    assert len(got) > 20 and sum("MapInArrow" in p for p in plans) >= 3
    assert not any("Join" in p or "Exchange" in p for p in plans if "text#" in p)


def kids_of(*kids):
    return json.dumps({"children": [dict(zip(("title", "startOffset", "endOffset"), k, strict=False)) for k in kids]})


def test_small_children_of_one_page_keep_their_order(frame):
    """Children that begin and end on the same pages were merged in the order of their titles, so that leaves didn't tile the text."""
    text = "It went on for a while. " * 800
    rules = [("decompose", kids_of(("Z", 0, 20), ("Y", 20, 40), ("X", 40, 60), ("W", 60, 9000), ("V", 9000, len(text))))]
    got = rows(M.build_tree(frame([(1, text)], "id int, text string"), 1000, 500, 1, make=lambda: M.Matching(rules)))
    assert sorted((r.title, r.start_off, r.end_off) for r in got.values() if r.is_leaf) == [("V", 9000, len(text)), ("W", 0, 9000)]


def test_offsets_beyond_any_text(frame):
    text = "It went on for a while. " * 800
    rules = [("decompose", kids_of(("A", 0, 9000), ("B", 9000, 10**13), ("C", 10**12, 10**13)))]
    got = rows(M.build_tree(frame([(1, text)], "id int, text string"), 1000, 500, 1, make=lambda: M.Matching(rules)))
    assert [(r.title, r.end_off) for _, r in sorted(got.items())] == [("Book", len(text)), ("A", 9000), ("B", len(text))]


def test_children_beside_their_text_are_those_of_the_tables(frame):
    """In one row: the same children as by joins and windows, also out of order, empty, overlapping and too many."""
    lot, schema = random.Random(5), "id int, text string, kids array<struct<title:string,startOffset:bigint,endOffset:bigint>>"
    text = lambda: "".join(lot.choice(["ab ", "é😀 ", "x\n\n", "word. "]) * lot.randint(1, 40) for _ in range(lot.randint(0, 40)))
    data = [(i, text(), [(lot.choice(["T", "  ", "A b", ""]) * lot.randint(0, 3), lot.randint(0, 3000), lot.choice([None, lot.randint(0, 4000)])) for _ in range(lot.randint(0, 14))]) for i in range(120)]
    df = frame(data, schema)
    got = df.select("id", F.explode(T.contiguous(F.col("kids"), F.col("text"))).alias("c")).select("id", "c.*")
    rest = df.select("id", F.length("text").alias("n"), F.explode("kids").alias("c")).select("id", "c.title", F.col("c.startOffset").alias("start_off"), F.coalesce("c.endOffset", "n").alias("end_off"))
    want = T.reconciled(rest, df.select("id", "text"))
    assert got.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pages = [(i, [(lo := k * 3 + lot.randint(0, 2), lo + lot.randint(0, 5), f"t{k}", k, k + 1) for k in range(lot.randint(1, 9))]) for i in range(60)]
    x = frame(pages, "id int, x array<struct<lo:int,hi:int,title:string,a:int,b:int>>")
    got = x.select("id", F.explode(T.merged_in_order(F.col("x"))).alias("c")).select("id", "c.title", "c.lo", "c.hi", "c.a", "c.b")
    want = T.merge_undersized(x.select("id", F.inline("x")).withColumnsRenamed({"a": "start_off", "b": "end_off"}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
