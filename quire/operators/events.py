"""Event logs and stored versions: latest states, folds, changes, and the ledger of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last event of each key by (ts, event_id); an aggregate, combined before its shuffle."""
    x = F.max(F.struct("ts", "event_id", *[F.col(c).alias(f"_{c}") for c in columns])).alias("x")
    return events.groupBy(key).agg(x).select(key, "x.ts", "x.event_id", *[F.col(f"x._{c}").alias(c) for c in columns])


def newest(events: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` newest events: a top-k report, taken per partition first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def folded(events: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, first_type, first_ts, flagged, n): first value wins; a flag, once set, stays set."""
    return events.groupBy(key).agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f"), F.bool_or(F.col("event_type") == flag).alias("flagged"), F.count("*").alias("n")).select(key, F.col("f.event_type").alias("first_type"), F.col("f.ts").alias("first_ts"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "n")


def since(events: DataFrame, ts: str) -> DataFrame:
    """Events strictly after ``ts``."""
    return events.where(F.col("ts") > F.lit(ts).cast("timestamp_ntz"))


def stale(events: DataFrame, key: str, state: str, minutes: int = 5) -> DataFrame:
    """Keys whose last event is ``state`` and older than ``minutes`` at the time of the log's last event."""
    last = latest_per_key(events, key, ["event_type"])
    now = events.agg(F.max("ts")).first()[0]  # one value
    return last.where((F.col("event_type") == state) & (F.col("ts") < F.lit(now) - F.make_dt_interval(mins=F.lit(minutes)))).select(key, "event_id", "ts")


def switches(events: DataFrame, key: str, state: str) -> DataFrame:
    """(key, event_id, on): where a key enters or leaves ``state`` in the order of its events."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    on = F.coalesce(F.col("event_type") == state, F.lit(False))
    x = events.select(key, "event_id", on.alias("on"), F.coalesce(F.lag(on).over(w), F.lit(False)).alias("was"))
    return x.where(F.col("on") != F.col("was")).select(key, "event_id", "on")


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, change): added, removed or changed between two snapshots; a null equals a null."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), new.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    x = a.join(b, keys, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return x.select(*keys, change.alias("change")).where("change is not null")


def token_ledger(calls: DataFrame) -> DataFrame:
    """(model, calls, counted, prompt, completion): totals; calls without counts are calls but not counted."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()).alias("counted"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion"))


def admitted(calls: DataFrame, key: str, order: list[str], size: str, ceiling: int) -> DataFrame:
    """(key, *order, size, admitted): calls in order, each admitted while what was admitted before leaves room for it.

    A call that doesn't fit is passed over and later, smaller ones may still fit, so it is a fold over a key's calls: they
    stream in order through one task that remembers what is used, and aren't collected.
    """
    x = calls.where(F.col(size).isNotNull()).select(key, *order, F.col(size).cast("long").alias(size))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, used, first = None, 0, True
        for pdf in parts:
            out = []
            for k, n in zip(pdf[key], pdf[size], strict=True):
                if first or k != of:
                    of, used, first = k, 0, False
                ok = used + n <= ceiling
                used += n if ok else 0
                out.append(ok)
            yield pdf.assign(admitted=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields) + ", admitted boolean"
    return x.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
