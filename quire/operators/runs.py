"""State of runs: phases of sections, progress, resumption, pinned settings, kinds of errors, and the ledger of a budget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of errors after which a call is tried again; floors of what a rate limit leaves; slack of a budget.
RETRYABLE = ("rate-limited", "network", "unknown")
LEAST_REQUESTS, LEAST_TOKENS, SLACK = 2, 1000, 1e-9


def progress(phases: DataFrame) -> DataFrame:
    """(run_id, total, done, errored, ratio) of (run_id, section_id, phase, status): done are sections with every phase done or skipped."""
    s = phases.groupBy("run_id", "section_id").agg(F.bool_and(F.col("status").isin("done", "skipped")).alias("done"), F.bool_or(F.col("status") == "error").alias("errored"))
    x = s.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if("errored").alias("errored"))
    return x.withColumn("ratio", F.col("done") / F.col("total"))


def in_flight(phases: DataFrame) -> DataFrame:
    """(run_id, section_id) of sections with any phase in flight."""
    return phases.where("status = 'in_flight'").select("run_id", "section_id").distinct()


def with_status(phases: DataFrame, phase: str, status: str) -> DataFrame:
    """(run_id, section_id) of sections whose ``phase`` has ``status``."""
    return phases.where((F.col("phase") == phase) & (F.col("status") == status)).select("run_id", "section_id").distinct()


def phase_counts(phases: DataFrame) -> DataFrame:
    """(run_id, phase, status, sections): counters of each phase."""
    return phases.groupBy("run_id", "phase", "status").agg(F.count("*").alias("sections"))


def reaped(phases: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """``phases`` with what has been in flight for longer than ``minutes`` set back to pending; those of unknown start stay."""
    old = (F.col("status") == "in_flight") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    old = F.coalesce(old, F.lit(False))
    return phases.withColumn("last_error", F.when(old, "orphan-reaped").otherwise(F.col("last_error"))).withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def current(states: DataFrame) -> DataFrame:
    """(run_id, status, phase, updated_at, created_at): where each run stands after (run_id, ts, seq, status, phase)."""
    x = states.groupBy("run_id").agg(F.max(F.struct("ts", "seq", "status", "phase")).alias("x"), F.min("ts").alias("created_at"))
    return x.select("run_id", "x.status", "x.phase", F.col("x.ts").alias("updated_at"), "created_at")


def resumable(runs: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` latest runs in progress or paused: a top-k report."""
    return runs.where(F.col("status").isin("in_progress", "paused")).orderBy(F.desc("updated_at"), F.desc("run_id")).limit(most)


def pinning(pinned: DataFrame, actual: DataFrame) -> DataFrame:
    """(run_id, name, change): settings of (run_id, name, value) that were added, removed or changed since a run began."""
    a = pinned.select("run_id", "name", F.col("value").alias("_a"), F.lit(True).alias("_in_a"))
    b = actual.select("run_id", "name", F.col("value").alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, ["run_id", "name"], "full_outer").select("run_id", "name", change.alias("change")).where("change is not null")


# ------------------------------------------------------------------------------------------------ errors and limits
def error_kind(status: Column, message: Column) -> Column:
    """The kind of a failed call by its HTTP status and message; the first that fits."""
    text = F.coalesce(message, F.lit(""))
    return (
        F.when(status.isin(401, 403), "authentication").when(status == 429, "rate-limited").when((status == 400) & text.rlike("(?i)context|too long|maximum"), "context-overflow")
        .when(status >= 500, "network").when(text.rlike("(?i)fetch failed|network|ECONN|ENOTFOUND"), "network").otherwise("unknown")
    )


def retryable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RETRYABLE), F.lit(False))


def rate_wait(now: Column, requests: Column, requests_reset: Column, tokens: Column, tokens_reset: Column) -> Column:
    """Milliseconds to wait before the next call: until a limit that is nearly used up is reset, if that is known."""
    wait = lambda left, least, reset: F.when(left < least, reset - now)
    return F.greatest(F.coalesce(wait(requests, LEAST_REQUESTS, requests_reset), F.lit(0)), F.coalesce(wait(tokens, LEAST_TOKENS, tokens_reset), F.lit(0)), F.lit(0))


# ------------------------------------------------------------------------------------------------ ledger
class Ledger:
    """A budget with reservations: what doesn't fit waits in order, and the first that waits goes first.

    Room is made by a higher ceiling, and also by commits and cancellations. Amounts never fall below 0.
    """

    def __init__(self, ceiling: float = 0.0):
        self.ceiling, self.reserved, self.billed = ceiling, 0.0, 0.0
        self.waiting: deque[tuple[object, float]] = deque()

    def _fits(self, size: float) -> bool:
        return self.reserved + self.billed + size <= self.ceiling + SLACK

    def drain(self) -> list:
        """Names of those that waited and now have room."""
        out = []
        while self.waiting and self._fits(self.waiting[0][1]):
            name, size = self.waiting.popleft()
            self.reserved += size
            out.append(name)
        return out

    def apply(self, op: str, name, size: float, actual: float | None = None) -> list[tuple[object, str]]:
        """(name, outcome) of what an operation leads to: admitted, parked, refused, committed, cancelled, dropped."""
        if size is None or size != size or size < 0 or actual is not None and actual < 0:
            return [(name, "refused")]
        if op == "reserve":
            if not self.waiting and self._fits(size):
                self.reserved += size
                return [(name, "admitted")]
            self.waiting.append((name, size))
            return [(name, "parked")]
        if op == "commit":
            self.reserved, self.billed = max(0.0, self.reserved - size), self.billed + (size if actual is None else actual)
            return [(name, "committed"), *((x, "admitted") for x in self.drain())]
        if op == "cancel":
            self.reserved = max(0.0, self.reserved - size)
            return [(name, "cancelled"), *((x, "admitted") for x in self.drain())]
        if op == "ceiling":
            self.ceiling = size
            return [(x, "admitted") for x in self.drain()]
        if op == "drop":
            gone, self.waiting = [x for x, _ in self.waiting], deque()
            return [(x, "dropped") for x in gone]
        return [(name, "refused")]


def replayed(ops: DataFrame, ceiling: float) -> DataFrame:
    """(run_id, seq, name, outcome, reserved, billed, waiting) of (run_id, seq, op, name, size): the ledger of each run in order of seq.

    A run's operations stream through one task in order, without being collected; its state is what waits.
    """
    cols = "run_id bigint, seq bigint, name bigint, outcome string, reserved double, billed double, waiting int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, ledger = None, Ledger(ceiling)
        for pdf in parts:
            out = []
            for r, q, op, name, size in zip(*(pdf[c] for c in ("run_id", "seq", "op", "name", "size")), strict=True):
                if r != of:
                    of, ledger = r, Ledger(ceiling)
                out += [(r, q, x, o, ledger.reserved, ledger.billed, len(ledger.waiting)) for x, o in ledger.apply(op, name, size)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in cols.split(", ")])

    typed = ops.select(F.col("run_id").cast("long"), F.col("seq").cast("long"), "op", F.col("name").cast("long"), F.col("size").cast("double"))
    return typed.repartition("run_id").sortWithinPartitions("run_id", "seq").mapInPandas(run, cols)
