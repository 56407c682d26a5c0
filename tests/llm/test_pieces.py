import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.pieces import cut_kinds, cuts, found, leaf_texts, pieces, split, tree


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,é中。#-", max_size=600), st.integers(8, 120), st.integers(0, 40))
def test_cover_limit_and_overlap(text, most, overlap):
    got = split(text, most, overlap)
    over = min(overlap, most // 2)
    assert all(b - a <= most for a, b in got)
    if len(text) > most:
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(x[1] - y[0] == min(over, x[1]) and y[1] > x[1] for x, y in zip(got, got[1:], strict=False))


def test_natural_boundaries():
    text = "Of the Ledger\n" + "The council waited here. " * 12 + "\nOf the Harbour\n" + "It stood low in winter. " * 12
    got = split(text, 400, 0)
    assert text[got[1][0] :].startswith("Of the Harbour")
    assert all(text[b - 1].isspace() or text[b - 1] == "." for _, b in got)


SECTION = "{0}\n" + "The council waited here for long. " * 4 + "\n"


def test_only_siblings_share_a_piece():
    """The tail of an oversized section isn't packed with the section behind it."""
    text = "# Alpha\n" + "It stood low. " * 70 + "\n# Beta\n" + "It rose again soon. " * 95 + "\n# Gamma\n" + "The end was near. " * 24
    got = [text[a:b] for a, b in split(text, 1500, 0)]
    assert got[0].startswith("# Alpha") and got[1].startswith("# Beta") and got[-1].startswith("# Gamma")
    assert not any("# Gamma" in x and "It rose" in x for x in got)


def test_headings_nest_by_rank():
    text = "# A\nintro\n## A1\nbody\n### A1a\ndeep\n## A2\nbody\n# B\nlast"
    top = tree(text)
    assert [text[k.lo : k.hi].split("\n")[0] for k in top.kids] == ["# A", "# B"]
    a = top.kids[0]
    assert [(k.kind, text[k.lo : k.hi].split("\n")[0]) for k in a.kids] == [("head", "# A"), ("paragraph", "intro"), ("heading", "## A1"), ("heading", "## A2")]
    assert [k.kind for k in a.kids[2].kids] == ["head", "paragraph", "heading"]
    books = tree("Part One\nx\nChapter 1\ny\nChapter 2\nz\nPart Two\nw")
    assert [len([k for k in b.kids if k.kind == "heading"]) for b in books.kids] == [2, 0]


def test_lists_and_markup_nest():
    text = "- one\n  - inner a\n  - inner b\n- two\nplain"
    top = tree(text)
    assert [text[k.lo : k.hi].strip().split("\n")[0] for k in top.kids] == ["- one", "- two", "plain"]
    assert len(top.kids[0].kids) == 3
    html = "<section>\n<h2>One</h2>\n<p>text</p>\n</section>\n<section>\n<p>more</p>\n</section>"
    top = tree(html)
    assert [html[k.lo : k.hi].strip()[-10:] for k in top.kids] == ["</section>", "</section>"] and top.kids[0].kids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab A.\n#-<p>/ul1é中。", max_size=400))
def test_a_tree_tiles_its_text(text):
    todo = [tree(text)]
    assert (todo[0].lo, todo[0].hi) == (0, len(text))
    while todo:
        n = todo.pop()
        if n.kids:
            assert n.kids[0].lo == n.lo and n.kids[-1].hi == n.hi and all(a.hi == b.lo for a, b in zip(n.kids, n.kids[1:], strict=False))
            todo += n.kids


def test_deep_trees_and_kinds_of_cuts():
    deep = "".join("  " * i + f"- item {i}\n" for i in range(3000))
    got = split(deep, 900, 20)
    assert max(b - a for a, b in got) <= 900
    text = "\n".join(SECTION.format(h) for h in ("# One", "# Two", "# Three"))
    assert [k for _, _, k in cuts(text, 200, 0)] == ["heading"] * 3
    assert {k for _, _, k in cuts("word " * 300, 100, 0)} == {"heading", "word"} and {k for _, _, k in cuts("x" * 300, 100, 0)} == {"heading", "character"}
    assert {k for _, _, k in cuts("It stood low. " * 30, 100, 0)} == {"heading", "sentence"}
    assert {k for _, _, k in cuts("it stood low; " * 30, 100, 0)} == {"heading", "clause"}


def test_unbroken_text_is_cut_anyway():
    got = split("x" * 10_000, 2500, 150)
    assert max(b - a for a, b in got) <= 2500 and got[-1][1] == 10_000
    assert split(None, 5, 1) == split("", 5, 1) == [(0, 0)] and split("abc", 5, 1) == [(0, 3)]


def _tables(frame):
    rng = random.Random(5)
    blocks, text = [], []
    rec = 0
    for p in range(1, 40):
        page = []
        for k in range(rng.randint(0, 4)):
            t = " ".join(rng.choice(["council", "ford", "waited", "low."]) for _ in range(rng.randint(1, 40)))
            kind = rng.choice(["body", "body", "header"])
            rec += 1
            blocks += [(rec, "b", p, k, t, kind)] * rng.choice([1, 1, 2])
            if kind == "body":
                page.append(t)
        blocks.append((1000 + p, "b", p, 9, " " if p % 2 else None, "body"))
        if page:
            text.append("\n".join(page))
    return frame(blocks, "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string"), "\n".join(text)


def test_leaf_texts_equal_the_book(frame):
    blocks, text = _tables(frame)
    at = [(1, 0, len(text)), (2, 5, 77), (3, len(text) - 9, len(text) + 500), (4, len(text) + 5, len(text) + 9), (5, 3, 10**15)]
    leaves = frame([(i, "b", a, b) for i, a, b in at], "rec_id bigint, book_id string, start_off bigint, end_off bigint")
    got = {r.rec_id: r.text for r in leaf_texts(leaves, blocks).collect()}
    assert got == {i: text[a:b] for i, a, b in at if text[a:b]}


def test_items(frame):
    blocks, text = _tables(frame)
    sections = frame([(1, "s" * 30), (1, "s" * 30), (2, "short"), (3, None)], "rec_id bigint, raw_text string")
    nodes = frame([(5, "b", 0, 300, True), (5, "b", 0, 300, True), (6, "b", 0, 300, False), (7, "b", 10**6, 10**6 + 99, True), (8, "b", None, 5, True), (9, "b", 9, 3, True)], "rec_id bigint, book_id string, start_off bigint, end_off bigint, is_leaf boolean")
    limits = frame([("section", 20, 5), ("leaf", 50, 10), ("other", None, None)], "item_kind string, max_chars int, overlap_chars int")
    got = pieces(sections, nodes, blocks, limits).collect()
    leaf = sorted((r.piece_no, r.piece_start, r.text) for r in got if r.rec_id == 5)
    assert leaf[0][2] == text[: len(leaf[0][2])] and len(leaf) >= 6
    assert [(r.piece_start, r.piece_end, r.text) for r in got if r.rec_id == 7] == [(0, 0, "")]
    assert sorted((r.item_kind, r.rec_id) for r in found(sections, nodes, blocks, limits).collect()) == [("leaf", 5), ("leaf", 7), ("section", 1)]
    kinds = cut_kinds(sections, nodes, blocks, limits).collect()
    assert sum(r.cuts for r in kinds) == len(got) - 3 and all(r.longest <= 50 for r in kinds)
    assert found(sections.where("false"), nodes.where("false"), blocks, limits).collect() == []
