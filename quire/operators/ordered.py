"""Running values over ordered groups of any size: two levels, so that no window runs over all that one group has.

A group's axis is divided into tiles. Each tile's total is an aggregate, combined before its shuffle; the windows then go
over the tiles of a group, and over the rows of one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(x: DataFrame, tiles: DataFrame, group: list[str]) -> DataFrame:
    """Rows beside what comes from other tiles; null groups meet as well."""
    other = tiles.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_tile").alias("_gt"), "_other")
    on = F.col("_tile").eqNullSafe(F.col("_gt"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return x.join(other, on, "left").drop("_gt", *[f"_g{i}" for i in range(len(group))])


def running(df: DataFrame, group: list[str], tile: Column, order: list, value: Column, into: str, how: str = "sum", own: bool = False) -> DataFrame:
    """``df`` with ``into``: the sum or maximum of ``value`` over the rows before each one in its group (``own``: and itself).

    ``tile`` must not fall along ``order``. Without rows before it, a sum is 0 and a maximum null.
    """
    agg = F.sum if how == "sum" else F.max
    x = df.withColumn("_tile", tile).withColumn("_v", value)
    tiles = x.groupBy(*group, "_tile").agg(agg("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy(F.col("_tile").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*group, "_tile", agg("_s").over(before).alias("_other"))
    w = Window.partitionBy(*group, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    x = _joined(x.withColumn("_own", agg("_v").over(w)), tiles, group)
    if how == "sum":
        return x.withColumn(into, F.coalesce("_own", F.lit(0)) + F.coalesce("_other", F.lit(0))).drop("_tile", "_v", "_own", "_other")
    return x.withColumn(into, F.greatest("_own", "_other")).drop("_tile", "_v", "_own", "_other")


def following(df: DataFrame, group: list[str], tile: Column, order: list, value: Column, into: str) -> DataFrame:
    """``df`` with ``into``: the least ``value`` of the rows behind each one in its group; null where there is none."""
    x = df.withColumn("_tile", tile).withColumn("_v", value)
    tiles = x.groupBy(*group, "_tile").agg(F.min("_v").alias("_s"))
    after = Window.partitionBy(*group).orderBy(F.col("_tile").asc_nulls_last()).rowsBetween(1, Window.unboundedFollowing)
    tiles = tiles.select(*group, "_tile", F.min("_s").over(after).alias("_other"))
    w = Window.partitionBy(*group, "_tile").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    x = _joined(x.withColumn("_own", F.min("_v").over(w)), tiles, group)
    return x.withColumn(into, F.least("_own", "_other")).drop("_tile", "_v", "_own", "_other")


def numbered(df: DataFrame, group: list[str], tile: Column, order: list, into: str) -> DataFrame:
    """``df`` with ``into``: the number of each row in its group, from 1."""
    return running(df, group, tile, order, F.lit(1), into, own=True).withColumn(into, F.col(into).cast("int"))


#: Stretches of an axis at most that an interval is laid over.
STRETCHES = 256


def overlaps(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Rows of ``left`` beside those of ``right`` with the same key whose half-open interval overlaps theirs, each pair once.

    ``names``: start and end columns of left, then of right; other columns must differ. The axis of a key is divided into
    as many stretches as it has intervals, at most STRETCHES, up to the last start of either side; both sides are laid over
    them and meet by an equi-join on (key, stretch), in the stretch where the later of the two begins. Intervals with a null
    bound or without extent overlap nothing. How many rows are laid out is not known to the planner, so that join shuffles.
    """
    a, b, c, d = names
    left, right = left.where(f"{a} < {b}"), right.where(f"{c} < {d}")
    starts = left.select(key, F.col(a).alias("s")).unionByName(right.select(key, F.col(c).alias("s")))
    axis = starts.groupBy(key).agg(F.min("s").alias("_first"), F.max("s").alias("_last"), F.least(F.count("*"), F.lit(STRETCHES)).alias("_n"))
    axis = axis.select(key, "_first", F.greatest(F.ceil((F.col("_last") - F.col("_first") + 1) / F.col("_n")), F.lit(1)).alias("_wide"), "_last")

    def laid(df: DataFrame, lo: str, hi: str, at: str) -> DataFrame:
        place = lambda x: F.floor((x - F.col("_first")) / F.col("_wide"))
        x = df.join(axis, key).withColumn(at, place(F.col(lo)))
        return x.withColumn("_stretch", F.explode(F.sequence(F.col(at), place(F.least(F.col(hi) - 1, F.col("_last")))))).drop("_first", "_wide", "_last").hint("merge")

    x = laid(left, a, b, "_al").join(laid(right, c, d, "_ar"), [key, "_stretch"])
    return x.where((F.col("_stretch") == F.greatest("_al", "_ar")) & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))).drop("_stretch", "_al", "_ar")
