import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.register import register_functions
from quire.operators import blocks as B
from quire.operators import structure as S

TEXTS = [None, "", " \n\t", "One.", "A b, c; d: e", "x" * 5000, "He said “no”… 😀 done", "Alder Bay in 1890 and \"a quote\" in Alder Bay"]


def col(frame, f):
    df = frame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    return [r.v for r in df.select("i", f(F.col("text")).alias("v")).orderBy("i").collect()]


def test_counts(frame):
    assert col(frame, T.word_count) == [None, *(len(t.split()) for t in TEXTS[1:])]
    assert col(frame, T.token_estimate) == [None, *(max(1, -(-len(t) // 4)) for t in TEXTS[1:])]


def test_truncate(frame):
    assert col(frame, lambda c: T.truncate_words(c, 2))[3:5] == ["One.", "A b…"]


def test_terms(frame):
    assert col(frame, T.named_terms)[7] == ["Alder Bay", "1890", '"a quote"']


def test_wrap_keeps_words(frame):
    lines = col(frame, lambda c: T.wrapped(c, 5))
    assert lines[1] == [] and lines[4] == ["A b,", "c; d:", "e"] and lines[5] == ["x" * 5000]


def test_html_and_names(frame):
    assert col(frame, T.paragraphs_html)[:3] == ["<p>[omitted]</p>"] * 3
    assert col(frame, lambda c: T.file_name(c))[0] == "book-short"


@pytest.mark.parametrize("raw,ms", [("1m30s", 90000.0), ("250ms", 250.0), ("12", 12000.0), ("1h", 3600000.0), ("later", None), (None, None)])
def test_duration(frame, raw, ms):
    assert frame([(raw,)], "t string").select(T.duration_ms(F.col("t")).alias("v")).first().v == ms


def test_sql_names(spark):
    register_functions(spark)
    assert spark.sql("SELECT quire_word_count('a b  c'), quire_token_estimate('abcde'), quire_length_hint(9000), quire_preview('abcdef', 2)").first()[:] == (3, 2, "medium", "ab…[4 more chars]")


def test_verse_and_cast_runs(frame):
    ddl = "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string, font_hint string"
    lines = ["A line of verse", "and another one", "the third of them", "A sentence that ends here.", "Cast", "A MERCHANT", "x" * 101, None]
    df = frame([(i, "b", 1, i, t, "body", "CMSY10" if i == 3 else None) for i, t in enumerate(lines)], ddl)
    assert [(r.lo, r.hi, r.lines) for r in B.verse_runs(df).collect()] == [(0, 2, 3)]
    assert [(r.lo, r.hi) for r in B.cast_runs(df).collect()] == [(4, 5)]
    assert {r.rec_id: r.reason for r in B.protected(df).collect()} == {0: "verse", 1: "verse", 2: "verse", 3: "font", 4: "cast", 5: "cast"}
    assert B.verse_runs(df.where("false")).collect() == []


def test_verse_stops_a_cast_list(frame):
    ddl = "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string, font_hint string"
    lines = ["Dramatis Personae.", "A MERCHANT of the town of Alder.", "a line of verse", "another line", "a third one", "THE WIDOW."]
    df = frame([(i, "b", 1, i, t, "body", None) for i, t in enumerate(lines)], ddl)
    assert [(r.lo, r.hi) for r in B.cast_runs(df).collect()] == [(0, 1)]


def test_front_and_back_matter(frame):
    heads = {2: "Contents", 3: "Preface to this edition", 5: "Foreword", 7: "Chapter one", 27: "Notes", 28: "Bibliography", 29: "Index of names"}
    rows = [("b", p, 0, heads.get(p, f"Running text of page {p}."), "body") for p in range(1, 31)] + [("c", p, 0, f"Plain {p}.", "body") for p in range(1, 31)]
    m = B.front_back_matter(frame(rows, "book_id string, page_no int, block_idx int, text string, classification string"))
    got = sorted((r.side, r.kind, r.lo, r.hi) for r in m.collect())
    assert got == [("back", "bibliography", 28, 28), ("back", "endnotes", 27, 27), ("back", "index", 29, 30), ("front", "foreword", 5, 30), ("front", "preface", 3, 4), ("front", "toc", 2, 2)]
    assert sorted(map(tuple, B.matter_spans(m).collect())) == [("b", "back", 27, 30), ("b", "front", 2, 30)]


def test_ranked_and_long_dedupe(frame):
    df = frame([("b", 5, "model", 1), ("b", 5, "outline", 0)] + [("b", p, f"t{p:03d}", 0) for p in range(10, 2000)], "book_id string, page_no int, title string, rank int")
    got = sorted((r.page_no, r.title) for r in S.dedupe_boundaries(df).collect())
    assert got[0] == (5, "outline") and [p for p, _ in got[1:]] == list(range(10, 2000, 3))


def test_windows_of_any_size(frame):
    b = "book_id string, page_no int"
    w = frame([("b", k, 10 * k + 1, 10 * k + 10) for k in range(3)], "book_id string, win int, lo int, hi int")
    got = {r.win: r.matched for r in S.boundary_crosscheck(frame([("b", 3)], b), frame([("b", 4), ("b", 25)], b), w).collect()}
    assert got == {0: True, 1: True, 2: False}
    assert [(r.windows, round(r.ratio, 3), r.hybrid) for r in S.disagreement(frame([("b", k, v) for k, v in got.items()], "book_id string, win int, matched boolean")).collect()] == [(3, 0.333, True)]


def test_wrap_of_long_texts(frame):
    assert frame([("word " * 200_000,)], "t string").select(F.size(T.wrapped(F.col("t"), 60)).alias("n")).first().n == 16667


def test_dedupe_keeps_distance_to_last_kept(frame):
    df = frame([("b", p, f"t{p}") for p in (1, 2, 4, 5, 9)] + [("c", 11, "x"), ("c", 11, "x")], "book_id string, page_no int, title string")
    assert sorted((r.book_id, r.page_no) for r in S.dedupe_boundaries(df).collect()) == [("b", 1), ("b", 4), ("b", 9), ("c", 11)]


def test_offsets_beyond_the_text(frame):
    blocks = frame([(1, "b", 1, 0, "abc", "body"), (2, "b", 2, 0, " ", "body"), (3, "b", 3, 0, "de", "body")], "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string")
    idx = B.page_index(blocks)
    assert [(r.page_no, r.start, r.chars) for r in idx.orderBy("page_no").collect()] == [(1, 0, 3), (3, 4, 2)]
    pts = frame([(i, "b", o) for i, o in enumerate([0, 3, 4, 5, 99, None])], "i int, book_id string, offset bigint")
    assert [(r.offset, r.page_no) for r in B.offset_pages(pts, idx, ["i"]).orderBy("offset").collect()] == [(0, 1), (3, 1), (4, 3), (5, 3), (99, 3)]
