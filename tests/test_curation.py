"""Exact cases of export plans on a tree root -> A(a1, a2), B(b1, b2)."""

import pytest
from pyspark.sql import functions as F

from quire.operators import curation as C
from quire.operators import ordered as O
from quire.operators import tree as T

DDL = "book_id string, node_id string, parent_id string, ord int, depth int, title string, start_off bigint, end_off bigint, start_page int, end_page int, is_leaf boolean, source string, summary_text string, summary_words int"
DISJOINT = {"a1": (1, 5), "a2": (6, 10), "b1": (11, 15), "b2": (16, 20)}
OVERLAP = {"a1": (1, 7), "a2": (7, 9), "b1": (9, 13), "b2": (13, 20)}
SHADOW = {"a1": (1, 9), "a2": (7, 9), "b1": (7, 13), "b2": (13, 20)}


def tree(frame, pages):
    at = {"a1": (0, 1000), "a2": (1000, 2000), "b1": (2000, 3000), "b2": (3000, 4000)}
    rows = [("k", "root", None, 0, 0, "Root", 0, 4000, 1, 20, False, "root", None, None), ("k", "A", "root", 0, 1, "A", 0, 2000, None, None, False, "toc", None, None), ("k", "B", "root", 1, 1, "B", 2000, 4000, None, None, False, "toc", None, None)]
    rows += [("k", n, n[0].upper(), i, 2, n, *at[n], *pages[n], True, "llm", "words of " + n, 3) for i, n in enumerate(at)]
    return frame(rows, DDL)


def inc(frame, out):
    return frame([("k", x, False) for x in out] or [("k", "none", True)], "book_id string, leaf_id string, included boolean")


def plan(frame, pages, out, total=20, offset=0):
    n = tree(frame, pages)
    _, d = C.export_plan(n, inc(frame, out), frame([("k", total)], "book_id string, page_count int"), offset)
    return sorted((r.node_id, r.lo, r.hi) for r in d.collect())


CASES = [
    (DISJOINT, [], []), (DISJOINT, ["a1"], [("a1", 1, 5)]), (DISJOINT, ["a1", "b2"], [("a1", 1, 5), ("b2", 16, 20)]), (OVERLAP, ["a1"], [("a1", 1, 6)]),
    (OVERLAP, ["a2"], [("a2", 8, 8)]), (SHADOW, ["a2"], []), (DISJOINT, ["a1", "a2"], [("A", 1, 10)]), (DISJOINT, ["a1", "a2", "b1", "b2"], [("root", 1, 20)]),
    (DISJOINT, ["a2", "b1"], [("a2", 6, 15)]),
]


def test_deletions(frame):
    """Every case is a book of its own."""
    n = i = None
    for k, (pages, out, _) in enumerate(CASES):
        a, b = tree(frame, pages).withColumn("book_id", F.lit(f"k{k}")), inc(frame, out).withColumn("book_id", F.lit(f"k{k}"))
        n, i = (a, b) if n is None else (n.unionByName(a), i.unionByName(b))
    _, d = C.export_plan(n, i, frame([(f"k{k}", 20) for k in range(len(CASES))], "book_id string, page_count int"))
    got = d.collect()
    for k, (_, out, want) in enumerate(CASES):
        assert sorted((r.node_id, r.lo, r.hi) for r in got if r.book_id == f"k{k}") == want, out


def test_pages_beyond_the_book_are_not_spread(frame):
    assert plan(frame, DISJOINT, ["b2"], 17) == [("b2", 16, 17)]


def test_pages_before_the_analysed_ones_stay(frame):
    assert plan(frame, DISJOINT, ["a1"], 25, 5) == [("a1", 6, 10)] and plan(frame, DISJOINT, ["b2"], 22, 5) == [("b2", 21, 22)]


def test_preflight(frame):
    n = tree(frame, DISJOINT)
    f = C.merged(C.fragments(n, inc(frame, ["a1"])))
    assert C.preflight(n, f).collect() == []
    for leaf, page in (("a1", "start_page"), ("a2", "end_page")):
        bad = n.withColumn(page, F.expr(f"if(node_id = '{leaf}', null, {page})"))
        assert [(r.missing, r.title) for r in C.preflight(bad, f).collect()] == [(1, leaf)]
        stats = C.export_stats(bad, inc(frame, ["a1"]), frame([("k", 20)], "book_id string, page_count int")).collect()
        assert [r.exportable for r in stats] == [False]


def test_edit_plan_goes_backwards(frame):
    n = tree(frame, DISJOINT)
    _, d = C.export_plan(n, inc(frame, ["a1", "b2"]), frame([("k", 20)], "book_id string, page_count int"))
    got = sorted(map(tuple, C.edit_plan(d, n, frame([("k", "b2", "word " * 900)], "book_id string, node_id string, text string")).select("step", "node_id", "lo", "inserted").collect()))
    assert got == [(1, "b2", 16, 2), (2, "a1", 1, 1)]


def chain(frame, n):
    rows = [("c", f"n{i}", f"n{i - 1}" if i else None, 0, i, f"t{i}", 0, 100, 1, 2, i == n - 1, "toc", "leaf words here", 3) for i in range(n)]
    return frame(rows, DDL)


def test_trees_of_any_depth(frame, n=12):
    t = chain(frame, n)
    chains = {r.node_id: r.chain for r in T.title_chains(t).collect()}
    assert len(chains) == n and chains[f"n{n - 1}"] == " › ".join(f"t{i}" for i in range(n))
    assert T.descendant_leaves(t).count() == n and T.summarize_tree(t).count() == n
    assert {r.state for r in C.states(t, frame([("c", f"n{n - 1}", False)], "book_id string, leaf_id string, included boolean")).collect()} == {"none"}


def test_circles_end(frame):
    rows = [("c", "a", "b", 0, 1, "a", 0, 9, 1, 1, False, "toc", None, 0), ("c", "b", "a", 0, 1, "b", 0, 9, 1, 1, False, "toc", None, 0), ("c", "l", "a", 0, 2, "l", 0, 9, 1, 1, True, "toc", "x", 1)]
    t = frame(rows, DDL)
    assert T.title_chains(t).count() == 0
    assert {r.node_id for r in T.descendant_leaves(t).collect()} == {"a", "b", "l"}


def test_running_and_overlaps_against_brute_force(spark, frame):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 90, 7)]), i, rng.randint(-5, 9)) for i in range(120)]
    df = frame(rows, "k string, at int, id int, v int")
    order = [F.col("at").asc_nulls_last(), "id"]
    tile = F.floor(F.col("at") / 20)
    got = {r.id: (r.s, r.m, r.f) for r in O.following(O.running(O.running(df, ["k"], tile, order, F.col("v"), "s"), ["k"], tile, order, F.col("v"), "m", "max", True), ["k"], tile, order, F.col("v"), "f").collect()}
    for k in ("a", "b", None):
        part = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for i, r in enumerate(part):
            assert got[r[2]] == (sum(x[3] for x in part[:i]), max(x[3] for x in part[: i + 1]), min((x[3] for x in part[i + 1 :]), default=None))
    left = [(i, "k", rng.randint(0, 5000), rng.randint(0, 5000)) for i in range(60)] + [(99, "k", 0, 10**12), (98, "k", None, 5)]
    right = [(i, "k", rng.randint(0, 5000), rng.randint(0, 5000)) for i in range(60)] + [(99, "k", 3, 10**13)]
    x = O.overlaps(frame(left, "i int, k string, a bigint, b bigint"), frame(right, "j int, k string, c bigint, d bigint"), "k", ("a", "b", "c", "d"))
    want = sorted((i, j) for i, _, a, b in left for j, _, c, d in right if a is not None and a < b and c < d and a < d and c < b)
    assert sorted((r.i, r.j) for r in x.collect()) == want


def test_closures_and_laid_intervals_are_not_broadcast(frame, monkeypatch):
    """A closure is a union, which takes no mark from its levels; how far intervals are laid out the planner can't know."""
    monkeypatch.setattr("quire.session.BROADCAST_ROWS", 5)
    n = tree(frame, DISJOINT)
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    under = T.descendant_leaves(n)
    assert under.count() == 12 and "BroadcastHashJoin" not in said(n.hint("merge").join(under, ["book_id", "node_id"])) + said(under.join(frame([("k",)], "book_id string"), "book_id"))
    both = frame([("k", 0, 9)], "k string, a int, b int"), frame([("k", 3, 5)], "k string, c int, d int")
    assert "Generate" not in said(O.overlaps(*both, "k", ("a", "b", "c", "d"))).split("SortMergeJoin", 1)[0]


def test_few_intervals_are_laid_over_few_stretches(frame):
    """Two intervals of a long axis: a row for each stretch of 256 would be laid out for nothing."""
    both = frame([("k", 0, 10**6)], "k string, a int, b int"), frame([("k", 10**6 - 9, 10**6 + 5)], "k string, c int, d int")
    x = O.overlaps(*both, "k", ("a", "b", "c", "d"))
    assert x.count() == 1
    text = x._jdf.queryExecution().executedPlan()
    laid = []

    def walk(p):
        if p.getClass().getSimpleName() == "GenerateExec":
            laid.append(p.metrics().apply("numOutputRows").value())
        kids = [p.executedPlan()] if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [p.plan()] if p.getClass().getSimpleName().endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        for k in kids:
            walk(k)

    x._jdf.collectToPython()
    walk(text)
    assert laid and sum(laid) <= 6


def test_snapping_searches_a_window_and_no_list_of_places(frame):
    """Each place used to be looked up in the whole text, from its start: 800 times for each child."""
    texts = [None, "", "\n\n", "a\n\n\nb", "é😀\n\nxy\n\nz", "x" * 500 + "\n\n" + "y" * 300 + "\n\n" + "z" * 500]
    rows = [(i, t, o) for i, t in enumerate(texts) for o in (-3, -1, 0, 1, 2, 3, 4, 7, 651, 652, 653, 1300, 2000)]

    def want(t, o):
        lo, hi = max(o - T.SNAP, 0), min(o + T.SNAP, len(t or ""))
        at = [(abs(i - o), i) for i in range(lo, max(hi, lo + 1)) if t is not None and t[i : i + 2] == "\n\n"]
        return min(at)[1] + 2 if at else o

    df = frame(rows, "id int, text string, o int")
    got = df.select("id", "o", T.snapped(F.col("text"), F.col("o")).alias("at"))
    assert "lambda" not in got._jdf.queryExecution().toString().lower()
    assert sorted((r.id, r.o, r["at"]) for r in got.collect()) == sorted((i, o, want(t, o)) for i, t, o in rows)
    p = frame([(1, "c", 0, 3), (1, "d", 3, 9)], "id int, title string, start_off int, end_off int")
    plan = T.reconciled(p, frame([(1, "some text")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("text#" not in line for line in plan.split("Join")[0].splitlines() if "Window" in line or "Sort" in line)


def test_mixed_fragments(frame):
    f = C.fragments(tree(frame, DISJOINT), inc(frame, ["a2"]))
    assert sorted((r.kind, r.node_id) for r in f.collect()) == [("bracket", "a2"), ("keep", "B"), ("keep", "a1")]


def test_touching_brackets_merge(frame):
    m = C.merged(C.fragments(tree(frame, DISJOINT), inc(frame, ["a2", "b1"]))).where("kind = 'bracket'").collect()
    assert [(r.node_id, r.start_off, r.end_off, r.parts, r.chars, r.hint) for r in m] == [("a2", 1000, 3000, 2, 2000, "short")]


def test_toggle_and_revert(frame):
    n, i = tree(frame, DISJOINT), inc(frame, ["a2"])
    chosen = frame([("k", "A"), ("k", "B")], "book_id string, node_id string")
    assert {r.leaf_id: r.included for r in C.toggled(n, i, chosen).collect()} == {"a1": True, "a2": True, "b1": False, "b2": False}
    s = C.applied(n, i, frame([("k", "B"), ("k", "b1")], "book_id string, node_id string"))
    assert {r.leaf_id: r.included for r in s.collect()} == {"a1": True, "a2": False, "b1": False, "b2": False}
    assert {r.leaf_id: r.included for r in C.reverted(s).collect()} == {"a1": True, "a2": False, "b1": True, "b2": True}


def test_chain_listing_and_rollup(frame):
    n = tree(frame, DISJOINT)
    assert {r.node_id: r.chain for r in T.title_chains(n).collect()}["b2"] == "Root › B › b2"
    assert [r.node_id for r in T.listing(n).orderBy("pos").collect()] == ["root", "A", "a1", "a2", "B", "b1", "b2"]
    s = {r.node_id: r.summary for r in T.summarize_tree(n).collect()}
    assert s["A"] == "words of a1 words of a2" and s["root"].startswith("words of a1") and len(s) == 7


def test_empty_tree(frame):
    n = tree(frame, DISJOINT).where("false")
    assert C.fragments(n, inc(frame, [])).collect() == [] and T.summarize_tree(n).collect() == []


def test_children_cap_and_degenerate(frame):
    text = "word " * 4000
    kids = frame([(1, f"c{i}", i * 1600, i * 1600 + 1600) for i in range(12)] + [(2, "A", 0, 700), (2, "Empty", 700, 700), (2, "B", 700, 1500), (3, "x", None, 4)], "id int, title string, start_off int, end_off int")
    got = T.reconciled(kids, frame([(1, text), (2, text[:1500]), (3, text)], "id int, text string")).orderBy("id", "start_off").collect()
    one = [(r.title, r.end_off) for r in got if r.id == 1]
    assert len(one) == 8 and one[-1] == ("Remaining material", 20000)
    assert [r.title for r in got if r.id == 2] == ["A", "B"]
