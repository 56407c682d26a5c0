"""Interval algebra per entity: continuous periods and the gaps between them.

Spark's session_window, with a duration of each row's own, merges overlapping intervals natively. Equal starts are
combined before the shuffle, and an entity's axis is divided into tiles, so that a book with a third of all rows is merged
in many tasks; ends that touch over the tiles' borders are joined with a running maximum at two levels, and the gaps
follow with the next start, found likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordered import following, running
from quire.session import checkpointed

#: Positions per tile of the first merge of offsets; pages have tiles of fewer.
TILE, PAGES = 1 << 10, 64
#: Tiles of the merge per tile of what runs over an entity.
WIDE = 64


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of the rows with equal ``keys`` the one with the greatest ``order`` (ties: the greatest columns); last write wins.

    Null keys are a group like any other. The choice is an aggregate, combined before its one shuffle.
    """
    pick = F.max(F.struct(*order, *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])).alias("_x")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_x._{i}").alias(c) for i, c in enumerate(columns)])


def periods(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", tile: int = TILE) -> DataFrame:
    """(*keys, lo, hi): maximal stretches [lo, hi) covered by the ranges [lo, hi) of each entity.

    Ranges that overlap, nest or touch are continuous. Ranges with a null bound or without extent are ignored; repeated
    rows change nothing; an empty table gives no rows; other columns are ignored.
    """
    r = ranges.select(*keys, F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi")).where("_lo < _hi")
    r = r.groupBy(*keys, "_lo").agg(F.max("_hi").alias("_hi"))
    at = F.timestamp_micros("_lo")
    span = F.concat((F.col("_hi") - F.col("_lo")).cast("string"), F.lit(" microseconds"))
    merged = r.select(*keys, F.floor(F.col("_lo") / tile).alias("_tile"), at.alias("_at"), span.alias("_span")).groupBy(*keys, "_tile", F.session_window("_at", F.col("_span")).alias("_w")).agg(F.count("*").alias("_n"))
    m = merged.select(*keys, F.unix_micros("_w.start").alias("_lo"), F.unix_micros("_w.end").alias("_hi"))
    m = checkpointed(m)
    order, wide = ["_lo", "_hi"], F.floor(F.col("_lo") / (tile * WIDE))
    x = running(m, keys, wide, order, F.col("_hi"), "_before", "max")
    opens = F.when(F.col("_before").isNull() | (F.col("_lo") > F.col("_before")), F.col("_lo"))
    x = running(x.withColumn("_opens", opens), keys, wide, order, F.col("_opens"), "_period", "max", own=True)
    return x.groupBy(*keys, "_period").agg(F.max("_hi").alias("hi")).select(*keys, F.col("_period").alias("lo"), "hi")


def gaps(covered: DataFrame, bounds: DataFrame, keys: list[str], first: Column, end: Column, tile: int = TILE) -> DataFrame:
    """(*keys, lo, hi): maximal stretches [lo, hi) of [first, end) of each row of ``bounds`` that no period covers.

    ``covered`` has disjoint periods as of ``periods``; an entity without any is one gap; one whose bounds are null or
    without extent has none.
    """
    b = bounds.select(*keys, first.cast("long").alias("_first"), end.cast("long").alias("_end")).where("_first < _end")
    # each period opens a gap behind it; the entity's own first position opens one before all
    opens = b.select(*keys, "_first", "_end", F.col("_first").alias("_from"), F.lit(None).cast("long").alias("_start"))
    rest = covered.join(b, keys).select(*keys, "_first", "_end", F.col("hi").alias("_from"), F.col("lo").alias("_start"))
    place = F.coalesce(F.floor(F.col("_start") / (tile * WIDE)), F.lit(-(1 << 62)))
    x = following(opens.unionByName(rest), keys, place, [F.col("_start").asc_nulls_first()], F.col("_start"), "_next")
    x = x.select(*keys, "_end", F.greatest("_from", "_first").alias("lo"), "_next")
    return x.select(*keys, "lo", F.least(F.coalesce("_next", "_end"), "_end").alias("hi")).where("lo < hi")


def book_periods(nodes: DataFrame, sections: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, kind, lo, hi): leaf periods and gaps in offsets [lo, hi), page periods and gaps in pages lo..hi.

    Books without ``total_chars`` are left out; of stored versions the latest counts; null and empty ranges are ignored.
    """
    b = books.where("total_chars is not null").select("book_id", "total_chars", "page_count").dropDuplicates(["book_id"])
    leaf = latest(nodes, ["book_id", "node_id"], ["stored_at", "rec_id"], ["start_off", "end_off", "is_leaf"]).where("is_leaf and start_off < end_off").join(b.select("book_id"), "book_id", "left_semi")
    page = latest(sections, ["book_id", "section_id"], ["stored_at", "rec_id"], ["start_page", "end_page"]).where("start_page <= end_page").join(b.select("book_id"), "book_id", "left_semi")
    lp = checkpointed(periods(leaf, ["book_id"], "start_off", "end_off"))
    pp = checkpointed(periods(page.withColumn("end_page", F.col("end_page") + 1), ["book_id"], "start_page", "end_page", PAGES))
    lg = gaps(lp, b, ["book_id"], F.lit(0), F.col("total_chars"))
    pg = gaps(pp, b, ["book_id"], F.lit(1), F.col("page_count") + 1, PAGES)
    closed = F.col("hi") - 1
    return (
        lp.select("book_id", F.lit("leaf_period").alias("kind"), "lo", "hi")
        .unionByName(lg.select("book_id", F.lit("leaf_gap").alias("kind"), "lo", "hi"))
        .unionByName(pp.select("book_id", F.lit("page_period").alias("kind"), "lo", closed.alias("hi")))
        .unionByName(pg.select("book_id", F.lit("page_gap").alias("kind"), "lo", closed.alias("hi")))
    )
