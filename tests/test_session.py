"""Checkpoint tables: where they lie, when they go; joins with a counted side."""

import pytest

from quire import session


def test_earlier_tables_are_freed(spark, frame):
    a = session.checkpointed(frame([(1,), (2,)], "x int"))
    b = session.checkpointed(a.selectExpr("x + 1 as x"), frees=a)
    assert sorted(r.x for r in b.collect()) == [2, 3]
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.schema("x int").parquet(a._table).collect()
    path = b._table
    session.release()
    assert path not in session._TABLES


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return None

        master = "spark://host:7077"

    class Dir:
        def isEmpty(self):  # noqa: N802
            return True

    class Sc(Fake):
        def getCheckpointDir(self):  # noqa: N802
            return Dir()

        def sc(self):
            return self

        @property
        def _jsc(self):
            return self

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Sc(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_met_gives_the_same_rows_either_way(frame):
    left, right = frame([(i, i % 7) for i in range(50)], "a int, k int"), frame([(1, "x"), (3, "y")], "k int, v string")
    small, large = (sorted(map(tuple, session.met(left, right, ["k"], "left", most).collect()), key=str) for most in (10, 1))
    assert small == large and len(small) == 50
    plan = session.met(left, right, ["k"], "left", 10)._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan and "strategy=broadcast" not in session.met(left, right, ["k"], "left", 1)._jdf.queryExecution().toString()


def test_large_tables_are_never_broadcast(frame, monkeypatch):
    """The files of a table of many rows can be far smaller than the rows; the planner goes by the files."""
    t = frame([(i, i % 7) for i in range(50)], "a int, k int")
    plan = lambda most: (monkeypatch.setattr(session, "BROADCAST_ROWS", most), session.checkpointed(t).join(session.checkpointed(t), "a"))[1]
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small, large = plan(50), plan(49)
    assert "BroadcastHashJoin" in said(small) and "BroadcastHashJoin" not in said(large)
    assert small.count() == large.count() == 50
