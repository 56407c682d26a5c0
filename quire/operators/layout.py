"""Positioned text items of a page: rows, columns, blocks with their boxes, and classes by bands of the page.

Items are (page_id, x, y, width, height, text, font), y from the top; a decoder of files that gives such items is plugged in
before. Rows depend on the running mean of the row before, so the items of a page stream in order through a fold that
remembers one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trimmed
from quire.operators.blocks import CAPTION, FOLIO, FOOTNOTE
from quire.session import checkpointed

# Tolerance of a row in line heights, least line height, least items and gap of a column split.
TOLERANCE, LEAST_HEIGHT, LEAST_ITEMS, LEAST_GAP = 0.6, 4.0, 20, 60.0


def flipped(items: DataFrame, page_height: str = "page_height") -> DataFrame:
    """Items with y counted from the top of the page."""
    return items.withColumn("y", F.col(page_height) - F.col("y"))


def clean_metadata(title: Column) -> Column:
    """A title or author as read from a file; blank is null."""
    return F.nullif(trimmed(title), F.lit(""))


def rows(items: DataFrame) -> DataFrame:
    """The items with ``row``: joined to the last row while |y - mean| <= tolerance * max(height, 4), the mean running."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, row, mean, n = None, 0, 0.0, 0
        for pdf in parts:
            out = []
            for page, y, h in zip(pdf["page_id"], pdf["y"], pdf["height"].fillna(0.0), strict=True):
                if page != of:
                    of, row, mean, n = page, 0, y, 1
                elif abs(y - mean) <= TOLERANCE * max(h, LEAST_HEIGHT):
                    mean, n = (mean * n + y) / (n + 1), n + 1
                else:
                    row, mean, n = row + 1, y, 1
                out.append(row)
            yield pdf.assign(row=out)

    x = items.select("page_id", "y", "x", "text", "width", F.coalesce("height", F.lit(0.0)).alias("height"), "font")
    schema = f"page_id {x.schema['page_id'].dataType.simpleString()}, y double, x double, text string, width double, height double, font string, row int"
    return x.repartition("page_id").sortWithinPartitions("page_id", "y", "x", "text").mapInPandas(run, schema)


def column_split(items: DataFrame, page_width: float) -> DataFrame:
    """(page_id, split): the middle of the widest gap over 60 between neighbouring x around the page's middle."""
    w = Window.partitionBy("page_id").orderBy("x")
    g = items.select("page_id", "x", F.lag("x").over(w).alias("p"), F.count("*").over(Window.partitionBy("page_id")).alias("n"))
    ok = (F.col("n") >= LEAST_ITEMS) & (F.col("p") < page_width / 2) & (F.col("x") > page_width / 2) & (F.col("x") - F.col("p") > LEAST_GAP)
    return g.where(ok).groupBy("page_id").agg(F.max(F.struct((F.col("x") - F.col("p")).alias("gap"), (-F.col("p")).alias("np"), ((F.col("x") + F.col("p")) / 2).alias("split"))).alias("b")).select("page_id", F.col("b.split").alias("split"))


def blocks(items: DataFrame, page_width: float) -> DataFrame:
    """(page_id, row, side, text, font, x, y, w, h): a block per row, or two where the page has columns, with its box.

    The font is the most frequent, ties go to the one that comes first in the row.
    """
    r = checkpointed(rows(items))
    r = r.join(column_split(r, page_width), "page_id", "left")
    side = F.when(F.col("split").isNotNull() & (F.col("x") + F.col("width") / 2 >= F.col("split")), 1).otherwise(0)
    k = ["page_id", "row", "side"]
    r = r.withColumn("side", side)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ")
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("h")]
    text = r.groupBy(*k).agg(F.regexp_replace(joined, "[ \\t]+", " ").alias("text"), *box)
    f = r.groupBy(*k, "font").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first")).groupBy(*k)
    f = f.agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "font")).alias("f")).select(*k, F.col("f.font").alias("font"))
    return text.join(f, k)


# Bands of a page's height for headers and footers, and for footnotes; share of pages of a repeated text.
BAND, NOTES, SHARE, LONGEST = 0.1, 0.75, 0.3, 80


def banded(blocks_: DataFrame, book: Column, page_height: float) -> DataFrame:
    """(page_id, row, side, kind): classes by the place of a block's middle on the page, its text, and what recurs in its book."""
    b = blocks_.select("page_id", "row", "side", trimmed(F.col("text")).alias("t"), book.alias("_book"), (F.col("y") + F.col("h") / 2).alias("mid"))
    top, bottom = F.col("mid") < BAND * page_height, F.col("mid") > (1 - BAND) * page_height
    pages = b.groupBy("_book").agg(F.count_distinct("page_id").alias("pages"))
    edge = b.where((top | bottom) & F.length("t").between(1, LONGEST)).groupBy("_book", "t").agg(F.count_distinct("page_id").alias("n"))
    again = edge.join(pages, "_book").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * SHARE))).select("_book", "t", F.lit(True).alias("again"))
    x = b.join(again, ["_book", "t"], "left")
    kind = (
        F.when(F.coalesce("t", F.lit("")) == "", "body").when(F.col("again") & top, "header").when(F.col("again") & bottom, "footer")
        .when(F.col("t").rlike(FOLIO) & (F.length("t") <= 6) & (top | bottom), "folio").when(F.col("t").rlike(CAPTION) & (F.length("t") < 200), "caption")
        .when((F.col("mid") > NOTES * page_height) & F.col("t").rlike(FOOTNOTE), "footnote").otherwise("body")
    )
    return x.select("page_id", "row", "side", kind.alias("kind"))
