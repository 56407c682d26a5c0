"""The ledger and the state of runs."""

from pyspark.sql import functions as F

from quire.operators import runs as R


def test_ledger_waits_in_order():
    led = R.Ledger(10)
    assert led.apply("reserve", "a", 6) == [("a", "admitted")] and led.apply("reserve", "b", 5) == [("b", "parked")]
    assert led.apply("reserve", "c", 1) == [("c", "parked")]  # not past the one that waits
    assert led.apply("commit", "a", 6, 4) == [("a", "committed"), ("b", "admitted"), ("c", "admitted")]
    assert (led.reserved, led.billed) == (6, 4) and led.apply("reserve", "d", 0.0) == [("d", "admitted")]
    assert led.apply("reserve", "e", 9) == [("e", "parked")] and led.apply("ceiling", None, 20) == [("e", "admitted")]
    assert led.apply("reserve", "f", 9) == [("f", "parked")] and led.apply("drop", None, 0) == [("f", "dropped")]
    assert led.apply("cancel", "x", 99) == [("x", "cancelled")] and led.reserved == 0
    assert led.apply("reserve", "g", -1) == [("g", "refused")] and led.apply("commit", "g", float("nan")) == [("g", "refused")]


def test_slack():
    led = R.Ledger(0.3)
    assert [led.apply("reserve", i, 0.1)[0][1] for i in range(4)] == ["admitted"] * 3 + ["parked"]


def test_replay_is_the_ledger_of_each_run(frame):
    import random

    rng = random.Random(4)
    ops = [(r, q, rng.choice(["reserve", "reserve", "commit", "cancel", "ceiling"]), q, rng.choice([None, 1.0, 5.0, 40.0])) for r in (1, 2, 3) for q in range(60)]
    got = sorted(map(tuple, R.replayed(frame(ops, "run_id long, seq long, op string, name long, size double"), 50.0).collect()))
    want = []
    for r in (1, 2, 3):
        led = R.Ledger(50.0)
        for _, q, op, name, size in (x for x in ops if x[0] == r):
            want += [(r, q, x, o, led.reserved, led.billed, len(led.waiting)) for x, o in led.apply(op, name, size)]
    assert got == sorted(want)


def test_progress_and_reaping(frame):
    df = frame([("r", "a", "p", "done", 0, None), ("r", "a", "q", "skipped", 0, None), ("r", "b", "p", "error", 0, None), ("r", "b", "q", "in_flight", 0, None)], "run_id string, section_id string, phase string, status string, at int, last_error string")
    df = df.withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [(r.total, r.done, r.errored, r.ratio) for r in R.progress(df).collect()] == [(2, 1, 1, 0.5)]
    late, soon = (F.lit(f"2024-01-01 00:{m}:00").cast("timestamp") for m in ("06", "05"))
    assert [r.last_error for r in R.reaped(df, late).collect()].count("orphan-reaped") == 1 and [r.status for r in R.reaped(df, soon).collect()].count("pending") == 0
    assert R.progress(df.where("false")).collect() == []
