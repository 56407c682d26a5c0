"""Blocks of a page: classes, runs of verse and cast lists, front and back matter, repeated headers, page texts.

Windows run within one page, which is small; what needs a whole book is an aggregate combined before its shuffle, or
runs over pages instead of blocks. Exact repeats of a record count once. Null and blank texts are body text of no use:
they break runs and add nothing to a page's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trimmed
from quire.operators.ordered import following, running

# Ends of a line that closes a sentence; openings of captions, footnotes, folios and cast lists.
TERMINAL = "[.!?…)\"”'’\\]]\\s*$"
CAPTION = r"(?i)^(?:figure|fig\.|table|plate|diagram|map)(?![A-Za-z0-9_])"
FOLIO = r"(?i)^(?:[ivxlcdm]+|[0-9]{1,4})$"
FOOTNOTE = r"^[¹²³⁰⁴-⁹*†‡§]|^[0-9]{1,3}[.)][ \t]+[^ \t\n]"
CAST = r"(?i)^(?:dramatis personae|cast of characters|cast|characters|personae)(?![A-Za-z0-9_])"
# Parts of font names of code and formulas.
FONTS = "mono courier consolas menlo cmsy cmmi cmex mtsy msam msbm stix".split()
# Headings of front and back matter, in order of precedence.
MATTER = [
    ("front", "toc", "table of contents|contents"), ("front", "preface", "preface"), ("front", "foreword", "foreword"), ("front", "translator-note", "translator['’]s note|note from the translator|translator['’]s introduction"),
    ("front", "dedication", "dedication"), ("front", "acknowledgments", "acknowledgments|acknowledgements"), ("back", "index", "index|general index|subject index"), ("back", "endnotes", "endnotes|notes"),
    ("back", "bibliography", "bibliography|works cited|references"), ("back", "appendix", "appendix"), ("back", "glossary", "glossary"),
]

PAGE = ["book_id", "page_no"]
#: Pages per tile of what runs over a book.
PAGES = 512


def records(blocks: DataFrame) -> DataFrame:
    """Blocks without exact repeats of a record."""
    return blocks.dropDuplicates(["rec_id"])


def repeated_edges(blocks: DataFrame, share: float = 0.3, longest: int = 80) -> DataFrame:
    """(book_id, text, pages): short texts that stand first or last on at least max(2, share of the pages) pages."""
    edge = blocks.groupBy(*PAGE).agg(F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"))
    pages = edge.groupBy("book_id").agg(F.count("*").alias("n"))
    t = blocks.join(edge, PAGE).where("block_idx = lo or block_idx = hi").select("book_id", "page_no", trimmed(F.col("text")).alias("text")).where(F.length("text").between(1, longest))
    per = t.distinct().groupBy("book_id", "text").agg(F.count("*").alias("pages"))
    return per.join(pages, "book_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share))).select("book_id", "text", "pages")


def classified(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rec_id, kind): class by place and shape; the first that fits: empty body, header, footer, folio, caption, footnote, body."""
    edge = blocks.groupBy(*PAGE).agg(F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"))
    b = blocks.withColumn("t", trimmed(F.col("text"))).join(edge, PAGE)
    b = b.join(repeated.select("book_id", F.col("text").alias("t"), F.lit(True).alias("again")), ["book_id", "t"], "left")
    top, bottom = F.col("block_idx") == F.col("lo"), F.col("block_idx") == F.col("hi")
    kind = (
        F.when(F.coalesce("t", F.lit("")) == "", "body").when(F.col("again") & top, "header").when(F.col("again") & bottom, "footer")
        .when(F.col("t").rlike(FOLIO) & (F.length("t") <= 6) & (top | bottom), "folio").when(F.col("t").rlike(CAPTION) & (F.length("t") < 200), "caption")
        .when(bottom & F.col("t").rlike(FOOTNOTE), "footnote").otherwise("body")
    )
    return b.select("rec_id", kind.alias("kind"))


def short_line(text: Column, below: int = 60) -> Column:
    """Whether a line is short and doesn't close a sentence."""
    t = trimmed(text)
    return F.coalesce(F.length(t).between(1, below - 1) & ~t.rlike(TERMINAL), F.lit(False))


def verse_runs(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(book_id, page_no, lo, hi, lines): runs of at least ``least`` consecutive short open body lines of a page."""
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    is_line = (F.coalesce(F.col("classification"), F.lit("")) == "body") & short_line(F.col("text"))
    x = blocks.select(*PAGE, "block_idx", is_line.alias("line")).withColumn("run", F.sum(F.when(F.col("line"), 0).otherwise(1)).over(w))
    return x.where("line").groupBy(*PAGE, "run").agg(F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"), F.count("*").alias("lines")).where(F.col("lines") >= least).select(*PAGE, "lo", "hi", "lines")


def cast_runs(blocks: DataFrame, longest: int = 100, least: int = 3) -> DataFrame:
    """(book_id, page_no, lo, hi): a cast heading and the body lines of at most ``longest`` characters that follow it.

    Verse is marked first, and what it protects ends a run.
    """
    t = F.coalesce(trimmed(F.col("text")), F.lit(""))
    body = F.coalesce(F.col("classification"), F.lit("")) == "body"
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    x = blocks.select(*PAGE, "block_idx", t.rlike(CAST).alias("head"), (body & short_line(F.col("text"))).alias("line"), (~body | (t == "") | (F.length(t) > longest)).alias("stop"))
    x = x.withColumn("run", F.sum(F.when(F.col("line"), 0).otherwise(1)).over(w))
    verse = F.col("line") & (F.count_if("line").over(Window.partitionBy(*PAGE, "run")) >= least)
    x = x.withColumn("stop", F.col("stop") | verse)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    x = x.select(*PAGE, "block_idx", "head", F.min(F.when(F.col("stop"), F.col("block_idx"))).over(after).alias("stop"), F.max("block_idx").over(after).alias("end"))
    x = x.where("head").select(*PAGE, F.col("block_idx").alias("lo"), F.coalesce(F.col("stop") - 1, F.col("end"), F.col("block_idx")).alias("hi"))
    return x.where("hi > lo")


def protected(blocks: DataFrame) -> DataFrame:
    """(rec_id, reason): body blocks in verse, then in cast lists, then in a font of code or formulas."""
    b = blocks.where("classification = 'body'").select("rec_id", *PAGE, "block_idx", F.lower(F.coalesce("font_hint", F.lit(""))).alias("font"))
    v = verse_runs(blocks).select(*PAGE, F.explode(F.sequence("lo", "hi")).alias("block_idx"), F.lit(True).alias("verse"))
    c = cast_runs(blocks).select(*PAGE, F.explode(F.sequence("lo", "hi")).alias("block_idx")).distinct().withColumn("cast", F.lit(True))
    font = F.exists(F.array(*[F.lit(x) for x in FONTS]), lambda x: F.contains(F.col("font"), x))
    x = b.join(v, [*PAGE, "block_idx"], "left").join(c, [*PAGE, "block_idx"], "left")
    return x.select("rec_id", F.when(F.col("verse"), "verse").when(F.col("cast"), "cast").when(font, "font").alias("reason")).where("reason is not null")


def front_back_matter(blocks: DataFrame) -> DataFrame:
    """(book_id, side, kind, lo, hi): the first page of each kind of matter near the front or back, and its run of pages.

    The first fifth (at least 10 pages) is searched for the front, the last for the back; a run goes on to the page
    before the next heading of the same side, or to the end of the book.
    """
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    t = trimmed(F.col("text"))
    cand = blocks.withColumn("k", F.row_number().over(w)).where("k <= 4").where(~F.coalesce("classification", F.lit("")).isin("header", "folio") & t.isNotNull() & F.length(t).between(1, 120))
    span = blocks.groupBy("book_id").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"))
    sides = []
    for side in ("front", "back"):
        hit = F.when(F.lit(False), F.lit(""))
        for i, (s, kind, pattern) in enumerate(MATTER):
            if s == side:
                hit = hit.when(t.rlike(f"(?i)^(?:{pattern})(?![A-Za-z0-9_])"), F.concat(F.lit(f"{i:02d}"), F.lit(kind)))
        sides.append(cand.select(*PAGE, "k", F.lit(side).alias("side"), hit.alias("hit")).where("hit is not null"))
    heads = sides[0].unionByName(sides[1]).groupBy(*PAGE, "side").agg(F.min(F.struct("k", "hit")).alias("x")).select(*PAGE, "side", F.substring("x.hit", 3, 99).alias("kind"))
    ws = Window.partitionBy("book_id", "side").orderBy("page_no")
    heads = heads.withColumn("next", F.lead("page_no").over(ws)).join(span, "book_id")
    n = F.col("last") - F.col("first") + 1
    reach = F.when(n <= 10, n).otherwise(F.greatest(F.lit(10), F.ceil(n * 0.2)))
    inside = F.when(F.col("side") == "front", F.col("page_no") < F.col("first") + reach).otherwise(F.col("page_no") > F.col("last") - reach)
    first = heads.where(inside).groupBy("book_id", "side", "kind").agg(F.min(F.struct("page_no", "next", "last")).alias("x"))
    return first.select("book_id", "side", "kind", F.col("x.page_no").alias("lo"), F.coalesce(F.col("x.next") - 1, F.col("x.last")).alias("hi"))


def matter_spans(matter: DataFrame) -> DataFrame:
    """(book_id, side, lo, hi): all pages of front and of back matter together."""
    return matter.groupBy("book_id", "side").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def page_texts(blocks: DataFrame, classes: tuple[str, ...] = ("body",), glue: str = "\n") -> DataFrame:
    """(book_id, page_no, text): a page's blocks of some classes that aren't blank, in order, joined."""
    b = blocks.where(F.col("classification").isin(*classes) & F.col("text").rlike(r"\S"))
    x = F.sort_array(F.collect_list(F.struct("block_idx", "text")))
    return b.groupBy(*PAGE).agg(F.array_join(F.transform(x, lambda y: y["text"]), glue).alias("text"))


def page_index(blocks: DataFrame) -> DataFrame:
    """(book_id, page_no, start, chars): where each page's text begins in the text of its book.

    Lengths are summed per page first; the running sum then goes over pages only, at two levels.
    """
    b = blocks.where((F.col("classification") == "body") & F.col("text").rlike(r"\S"))
    p = b.groupBy(*PAGE).agg(F.sum(F.length("text") + 1).alias("n"))
    return running(p, ["book_id"], F.floor(F.col("page_no") / PAGES), ["page_no"], F.col("n"), "start").select(*PAGE, "start", (F.col("n") - 1).alias("chars"))


def offset_pages(points: DataFrame, index: DataFrame, keys: list[str], offset: str = "offset") -> DataFrame:
    """(*keys, offset, page_no) of each (book_id, offset): the last page that starts at or before it.

    Points and page starts are laid out together per book and tile of offsets, so that a book's points are spread over
    tasks; each tile begins with the page that reaches into it.
    """
    tile = 1 << 16
    pages = following(index.select("book_id", "page_no", "start", "chars"), ["book_id"], F.floor(F.col("page_no") / PAGES), ["page_no"], F.col("start"), "next")
    pages = pages.select("book_id", "page_no", "start", F.coalesce("next", F.col("start") + F.col("chars") + 1).alias("end"), F.col("next").isNull().alias("final"))
    tiles = pages.select("book_id", "page_no", "start", "end", "final", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("tile"))
    last = pages.where("final").select("book_id", F.col("page_no").alias("last_page"), F.col("end").alias("text_end"))
    p = points.where(F.col(offset).isNotNull()).withColumn("tile", F.floor(F.greatest(F.col(offset), F.lit(0)) / tile))
    hit = p.join(tiles, ["book_id", "tile"]).where((F.greatest(F.col(offset), F.lit(0)) >= F.col("start")) & (F.greatest(F.col(offset), F.lit(0)) < F.col("end"))).select("book_id", *keys, offset, "page_no")
    beyond = p.join(last, "book_id").where(F.col(offset) >= F.col("text_end")).select("book_id", *keys, offset, F.col("last_page").alias("page_no"))
    return hit.unionByName(beyond).select(*keys, offset, "page_no")
