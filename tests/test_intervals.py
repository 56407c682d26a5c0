from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.intervals import book_periods, gaps, latest, periods
from pyspark.sql import functions as F

DDL = "k string, lo bigint, hi bigint"


def brute(rows):
    out = []
    for lo, hi in sorted((a, b) for a, b in rows if a is not None and b is not None and a < b):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def test_overlap_nest_touch_and_gap(frame):
    df = frame([("a", 0, 5), ("a", 3, 4), ("a", 5, 9), ("a", 12, 20), ("a", 12, 20), ("a", 15, 16), ("b", 7, 7), ("b", None, 3), ("b", 9, 2), ("c", -4, -1)], DDL)
    p = periods(df, ["k"])
    assert sorted(map(tuple, p.collect())) == [("a", 0, 9), ("a", 12, 20), ("c", -4, -1)]
    b = frame([("a", 0, 25), ("b", 0, 3), ("z", 0, 0), ("n", 0, None)], "k string, first bigint, end bigint")
    assert sorted(map(tuple, gaps(p, b, ["k"], F.col("first"), F.col("end")).collect())) == [("a", 9, 12), ("a", 20, 25), ("b", 0, 3)]


def test_tiles_do_not_cut_periods(frame):
    rows = [("a", i * 7, i * 7 + 8) for i in range(200)] + [("a", 5000, 5010), ("a", 100, 3000)]
    got = sorted((r.lo, r.hi) for r in periods(frame(rows, DDL), ["k"], tile=64).collect())
    assert got == brute([(a, b) for _, a, b in rows])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 60)), max_size=25))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([("a", a, b) for a, b in rows] or [("a", None, None)], DDL)
    assert sorted((r.lo, r.hi) for r in periods(df, ["k"], tile=16).collect()) == brute(rows)


def test_empty_and_extra_columns(frame):
    df = frame([("a", 1, 2, "x", "y")], DDL + ", _lo string, n string")
    assert periods(df.drop("_lo"), ["k"]).collect()[0].hi == 2
    assert periods(df.where("false"), ["k"]).collect() == []


def test_last_write_wins(frame):
    df = frame([("a", 1, 1, "old"), ("a", 2, 2, "new"), ("a", 2, 2, "new"), (None, 1, 3, "n")], "k string, t int, rec_id int, v string")
    assert sorted((str(r.k), r.v) for r in latest(df, ["k"], ["t", "rec_id"], ["v"]).collect()) == [("None", "n"), ("a", "new")]


def test_pages_are_inclusive(frame):
    nodes = frame([("b", "n1", 1, 1, 0, 5, True), ("b", "n1", 2, 2, 0, 4, True), ("b", "n2", 1, 3, 6, 6, True), ("b", "n3", 1, 4, 0, 9, False)], "book_id string, node_id string, stored_at int, rec_id bigint, start_off bigint, end_off bigint, is_leaf boolean")
    sections = frame([("b", "s1", 1, 1, 1, 2), ("b", "s2", 1, 2, 3, 3), ("b", "s3", 1, 3, 6, 5), ("b", "s4", 1, 4, 5, None)], "book_id string, section_id string, stored_at int, rec_id bigint, start_page int, end_page int")
    books = frame([("b", 10, 5), ("open", None, None)], "book_id string, total_chars bigint, page_count int")
    got = sorted(map(tuple, book_periods(nodes, sections, books).collect()))
    assert got == [("b", "leaf_gap", 4, 10), ("b", "leaf_period", 0, 4), ("b", "page_gap", 4, 5), ("b", "page_period", 1, 3)]
