"""Structure of a book: windows of pages, boundaries, their check against each other, and sections built from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.blocks import PAGES, page_texts
from quire.operators.ordered import numbered, running
from quire.operators.tree import title_chains


def page_windows(pages: DataFrame, size: int = 50) -> DataFrame:
    """(book_id, win, lo, hi): tumbling windows of ``size`` pages from page 1 to the last page of each book."""
    last = pages.groupBy("book_id").agg(F.max("page_no").alias("last"))
    return last.select("book_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / size))).alias("win"), "last").select("book_id", "win", (F.col("win") * size + 1).alias("lo"), F.least((F.col("win") + 1) * size, F.col("last")).alias("hi"))


def sample_windows(windows: DataFrame, rate: float = 0.1) -> DataFrame:
    """The evenly spaced windows floor(i * n / count) of each book, count = max(1, round(n * rate))."""
    n = windows.groupBy("book_id").agg(F.count("*").alias("n"))
    count = F.greatest(F.lit(1), F.floor(F.col("n") * rate + 0.5))
    pick = n.select("book_id", "n", count.alias("c")).select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least("c", "n").cast("long") - 1)).alias("i"), "n", "c").select("book_id", F.floor(F.col("i") * F.col("n") / F.least("c", "n")).alias("win")).distinct()
    return windows.join(pick, ["book_id", "win"], "left_semi")


def window_texts(blocks: DataFrame, size: int = 50) -> DataFrame:
    """(book_id, win, text): pages of a window with a heading line each; body, headers and captions joined by blanks."""
    p = page_texts(blocks, ("body", "header", "caption"), " ").withColumn("win", F.floor((F.col("page_no") - 1) / size))
    x = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return p.groupBy("book_id", "win").agg(F.array_join(F.transform(x, lambda y: F.concat(F.lit("--- page "), y["page_no"].cast("string"), F.lit(" ---\n"), y["text"])), "\n").alias("text"))


def boundary_crosscheck(outline: DataFrame, model: DataFrame, windows: DataFrame, tolerance: int = 2) -> DataFrame:
    """(book_id, win, matched): whether, within a window, each boundary of one side is near one of the other.

    ``outline`` and ``model`` have (book_id, page_no), ``windows`` (book_id, win, lo, hi) of any size. Nearness is an equi-join
    on the pages around a boundary, both ways.
    """
    span = int(tolerance)
    pages = F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))
    page = windows.select("book_id", "win", F.explode(pages).alias("page_no"))
    placed = lambda b: b.select("book_id", "page_no").distinct().join(page, ["book_id", "page_no"])
    one, two = placed(outline), placed(model)

    def unmatched(a, b):
        near = b.select("book_id", "win", F.explode(F.sequence(F.col("page_no") - span, F.col("page_no") + span)).alias("page_no")).distinct()
        return a.join(near, ["book_id", "win", "page_no"], "left_anti").select("book_id", "win")

    bad = unmatched(one, two).unionByName(unmatched(two, one)).distinct().withColumn("bad", F.lit(True))
    return windows.select("book_id", "win").join(bad, ["book_id", "win"], "left").select("book_id", "win", F.col("bad").isNull().alias("matched"))


def disagreement(checked: DataFrame, most: float = 0.3) -> DataFrame:
    """(book_id, windows, ratio, hybrid): the share of compared windows that don't match; over ``most`` both sides are used."""
    x = checked.groupBy("book_id").agg(F.count("*").alias("windows"), F.count_if(~F.col("matched")).alias("bad"))
    ratio = F.col("bad") / F.col("windows")
    return x.select("book_id", "windows", ratio.alias("ratio"), (ratio > most).alias("hybrid"))


def mean_confidence(bounds: DataFrame, least: float = 0.4) -> DataFrame:
    """(book_id, confidence, low): the mean confidence of a book's boundaries, and whether it is under ``least``."""
    c = bounds.groupBy("book_id").agg(F.avg("confidence").alias("confidence"))
    return c.select("book_id", "confidence", (F.col("confidence") < least).alias("low"))


def dedupe_boundaries(bounds: DataFrame, distance: int = 2) -> DataFrame:
    """(book_id, page_no, title): of each book's boundaries those further than ``distance`` from the last one kept.

    On one page the least ``rank`` (where there is such a column), then title, counts. A boundary further than ``distance``
    from the one before is kept whatever came before that, so the choice runs over stretches of near ones only: they stream
    in order through a fold that remembers one page.
    """
    rank = F.col("rank") if "rank" in bounds.columns else F.lit(0)
    first = bounds.where("page_no is not null").groupBy("book_id", "page_no").agg(F.min(F.struct(rank.alias("rank"), "title")).alias("x"))
    tile = F.floor(F.col("page_no") / PAGES)
    p = running(first, ["book_id"], tile, ["page_no"], F.col("page_no"), "prev", "max")
    far = F.col("prev").isNull() | (F.col("page_no") - F.col("prev") > distance)
    p = running(p.withColumn("new", F.when(far, 1).otherwise(0)), ["book_id"], tile, ["page_no"], F.col("new"), "run", own=True)

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last = None, 0
        for pdf in parts:
            mark = []
            for book, run, page in zip(pdf["book_id"], pdf["run"], pdf["page_no"], strict=True):
                ok = (book, run) != of or page - last > distance
                of, last = (book, run), page if ok else last
                mark.append(ok)
            yield pdf.loc[mark, ["book_id", "page_no", "title"]]

    rows = p.select("book_id", "run", "page_no", F.col("x.title").alias("title")).repartition("book_id", "run").sortWithinPartitions("book_id", "run", "page_no")
    return rows.mapInPandas(keep, "book_id string, page_no int, title string")


def with_opening(bounds: DataFrame) -> DataFrame:
    """Adds the boundary 'Opening' on page 1 to books whose first boundary is later."""
    first = bounds.groupBy("book_id").agg(F.min("page_no").alias("p")).where("p > 1")
    return bounds.unionByName(first.select("book_id", F.lit(1).alias("page_no"), F.lit("Opening").alias("title")))


def sections_from(bounds: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, ord, title, start_page, end_page): a section runs to the page before the next boundary, the last to the end."""
    last = pages.groupBy("book_id").agg(F.max("page_no").alias("last"))
    w = Window.partitionBy("book_id").orderBy("page_no", "title")
    x = bounds.select("book_id", "page_no", "title", F.row_number().over(w).alias("ord"), F.lead("page_no").over(w).alias("next")).join(last, "book_id")
    return x.select("book_id", "ord", "title", F.col("page_no").alias("start_page"), F.least(F.greatest(F.col("page_no"), F.coalesce(F.col("next") - 1, F.col("last"))), F.greatest("last", "page_no")).alias("end_page"))


def spine_sections(blocks: DataFrame) -> DataFrame:
    """(book_id, spine_item_id, ord, start_page, title): spine items by first page; the title is the page's first text."""
    first = blocks.where("spine_item_id is not null").groupBy("book_id", "spine_item_id").agg(F.min("page_no").alias("start_page"))
    text = blocks.where(F.col("text").rlike(r"\S")).groupBy("book_id", F.col("page_no").alias("start_page")).agg(F.min(F.struct("block_idx", "text")).alias("t"))
    w = Window.partitionBy("book_id").orderBy("start_page", "spine_item_id")
    x = first.join(text, ["book_id", "start_page"], "left").withColumn("ord", F.row_number().over(w))
    title = F.substring(F.regexp_replace("t.text", r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""), 1, 80)
    return x.select("book_id", "spine_item_id", "ord", "start_page", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Spine item "), F.col("ord").cast("string"))).alias("title"))


def slice_preamble(blocks: DataFrame, first: int) -> DataFrame:
    """Blocks from page ``first`` on, with pages counted from 1 again."""
    return blocks.where(F.col("page_no") >= first).withColumn("page_no", F.col("page_no") - (first - 1))


def oversized_cuts(blocks: DataFrame, sections: DataFrame, most: int) -> DataFrame:
    """(book_id, rec_id, part, lo, hi, chars): sections over ``most`` characters divided at blocks, greedily by size.

    Block lengths are summed within a section; a part begins where the running sum enters the next multiple of the limit.
    """
    b = blocks.where((F.col("classification") == "body") & F.col("text").rlike(r"\S")).select("book_id", "page_no", "block_idx", (F.length("text") + 1).alias("n"))
    s = sections.where("start_page <= end_page").select("rec_id", "book_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    w = Window.partitionBy("rec_id").orderBy("page_no", "block_idx")
    x = s.join(b, ["book_id", "page_no"]).withColumn("upto", F.sum("n").over(w)).withColumn("part", F.floor((F.col("upto") - F.col("n")) / most))
    total = x.groupBy("rec_id").agg(F.sum("n").alias("all")).where(F.col("all") > most)
    return x.join(total, "rec_id", "left_semi").groupBy("book_id", "rec_id", "part").agg(F.min(F.struct("page_no", "block_idx")).alias("a"), F.max("page_no").alias("hi"), F.sum("n").alias("chars")).select("book_id", "rec_id", "part", F.col("a.page_no").alias("lo"), "hi", "chars")


def split_at(blocks: DataFrame, sections: DataFrame, cuts: DataFrame) -> DataFrame:
    """(book_id, rec_id, ord, title, confidence, lo, hi, chars): sections divided where ``cuts`` say; others stay whole.

    ``sections``: (rec_id, book_id, ord, title, start_page, end_page, confidence); ``cuts``: (rec_id, block_no, title), a part
    ends before block number ``block_no`` (from 1) of its section and has the cut's title, what is left has the section's with
    " (cont.)". Cuts outside 2..number of blocks don't count. All are numbered again in order.
    """
    b = blocks.select("book_id", "page_no", "block_idx", F.when((F.col("classification") == "body") & F.col("text").rlike(r"\S"), F.length("text")).alias("n"))
    s = sections.where("start_page <= end_page")
    each = s.select("rec_id", "book_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no")).join(b, ["book_id", "page_no"])
    tile = F.floor(F.col("page_no") / PAGES)
    each = numbered(each, ["rec_id"], tile, ["page_no", "block_idx"], "k")
    total = each.groupBy("rec_id").agg(F.max("k").alias("blocks"))
    c = cuts.join(total, "rec_id").where("block_no > 1 and block_no <= blocks").groupBy("rec_id", "block_no").agg(F.min("title").alias("cut_title"))
    marks = each.join(c.select("rec_id", F.col("block_no").alias("k"), F.lit(1).alias("cut")), ["rec_id", "k"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    parts = running(marks, ["rec_id"], tile, ["page_no", "block_idx"], F.col("cut"), "part", own=True)
    size = F.greatest(F.coalesce(F.sum(F.col("n") + 1), F.lit(0)) - 1, F.lit(0))
    p = parts.groupBy("rec_id", "book_id", "part").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"), size.alias("chars"))
    w = Window.partitionBy("rec_id").orderBy("block_no")  # the cuts of one section
    named = c.select("rec_id", (F.row_number().over(w) - 1).alias("part"), "cut_title")
    many = c.select("rec_id").distinct().withColumn("many", F.lit(True))
    x = p.join(named, ["rec_id", "part"], "left").join(many, "rec_id", "left").join(s.select("rec_id", F.col("ord").alias("old"), "title", "confidence"), "rec_id")
    title = F.when(F.col("many").isNull(), F.col("title")).otherwise(F.coalesce("cut_title", F.concat(F.col("title"), F.lit(" (cont.)"))))
    x = x.select("book_id", "rec_id", "old", "part", title.alias("title"), F.when(F.col("many"), F.lit(0.6)).otherwise(F.col("confidence")).alias("confidence"), "lo", "hi", "chars")
    return numbered(x, ["book_id"], F.floor(F.coalesce("old", F.lit(0)) / 64), [F.coalesce("old", F.lit(0)), "rec_id", "part"], "ord").drop("old", "part")


def flattened(outline: DataFrame) -> DataFrame:
    """(book_id, pos, node_id, depth, title, start_page): an outline (book_id, node_id, parent_id, ord, title, start_page) depth first."""
    o = outline.withColumn("step", F.concat(F.format_string("%08d", F.coalesce("ord", F.lit(0))), F.lit(":"), "node_id"))
    paths = title_chains(o.select("book_id", "node_id", "parent_id", F.col("step").alias("title")), "\u0001")
    x = o.join(paths, ["book_id", "node_id"])
    depth = F.size(F.split("chain", "\u0001")) - 1
    place = numbered(x.withColumn("depth", depth), ["book_id"], F.lit(0), ["chain"], "pos")
    return place.select("book_id", "pos", "node_id", "depth", "title", "start_page")
