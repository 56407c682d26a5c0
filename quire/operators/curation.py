"""Inclusion of leaves, its state in the tree, and the export plan: fragments, merged brackets, pages to delete.

``inclusion`` is (book_id, leaf_id, included); a leaf without a row is included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import length_hint, wrapped
from quire.operators.ordered import overlaps, running
from quire.operators.tree import TILE, descendant_leaves
from quire.session import checkpointed

NODE = ["book_id", "node_id"]


def _under(nodes: DataFrame, under: DataFrame | None) -> DataFrame:
    return descendant_leaves(nodes) if under is None else under


def leaf_inclusion(nodes: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(book_id, leaf_id, included) of every leaf."""
    i = inclusion.groupBy("book_id", "leaf_id").agg(F.bool_and("included").alias("included"))
    return nodes.where("is_leaf").select("book_id", F.col("node_id").alias("leaf_id")).join(i, ["book_id", "leaf_id"], "left").select("book_id", "leaf_id", F.coalesce("included", F.lit(True)).alias("included"))


def states(nodes: DataFrame, inclusion: DataFrame, under: DataFrame | None = None) -> DataFrame:
    """(book_id, node_id, state, leaves, kept): all, none or mixed by the leaves below; none without leaves."""
    x = _under(nodes, under).join(leaf_inclusion(nodes, inclusion), ["book_id", "leaf_id"]).groupBy(*NODE).agg(F.count("*").alias("leaves"), F.count_if("included").alias("kept"))
    y = nodes.select(*NODE).join(x, NODE, "left")
    state = F.when(F.coalesce("kept", F.lit(0)) == 0, "none").when(F.col("kept") == F.col("leaves"), "all").otherwise("mixed")
    return y.select(*NODE, state.alias("state"), F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("kept", F.lit(0)).alias("kept"))


def fragments(nodes: DataFrame, inclusion: DataFrame, under: DataFrame | None = None) -> DataFrame:
    """(book_id, node_id, kind, start_off, end_off, leaves): maximal uniform subtrees, kept or bracketed.

    A fragment is a node with one state whose parent is mixed, or which has none; a subtree without leaves is none.
    """
    s = states(nodes, inclusion, under)
    up = s.select("book_id", F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
    n = nodes.select(*NODE, "parent_id", "start_off", "end_off").join(s, NODE).join(up, ["book_id", "parent_id"], "left")
    f = n.where((F.col("state") != "mixed") & (F.col("leaves") > 0) & (F.col("above").isNull() | (F.col("above") == "mixed")))
    return f.select(*NODE, F.when(F.col("state") == "all", "keep").otherwise("bracket").alias("kind"), "start_off", "end_off", "leaves")


def merged(frags: DataFrame) -> DataFrame:
    """(book_id, kind, node_id, start_off, end_off, parts, chars, hint): neighbouring brackets whose offsets touch become one.

    A merged bracket keeps the node of its first part, and has the characters of all. Fragments without offsets are left out.
    """
    f = checkpointed(frags.where("start_off is not null and end_off is not null"))
    order, tile = ["start_off", "end_off", "node_id"], F.floor(F.col("start_off") / TILE)
    row = F.struct("start_off", "end_off", "node_id", "kind")
    x = running(f, ["book_id"], tile, order, row, "prev", "max")  # the greatest row before one is the one before it
    joined = (F.col("kind") == "bracket") & (F.col("prev.kind") == "bracket") & (F.col("prev.end_off") == F.col("start_off"))
    x = checkpointed(x.select(*NODE, "kind", "start_off", "end_off", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1).alias("new")))
    x = running(x, ["book_id"], tile, order, F.col("new"), "run", own=True)
    m = x.groupBy("book_id", "run", "kind").agg(
        F.min(F.struct("start_off", "end_off", "node_id")).alias("a"), F.max("end_off").alias("end_off"), F.count("*").alias("parts"), F.sum(F.col("end_off") - F.col("start_off")).alias("chars")
    )
    return m.select("book_id", "kind", F.col("a.node_id").alias("node_id"), F.col("a.start_off").alias("start_off"), "end_off", "parts", "chars", length_hint(F.col("chars")).alias("hint"))


def _met_leaves(nodes: DataFrame, frags: DataFrame) -> DataFrame:
    """Fragments beside the leaves whose offsets overlap theirs."""
    leaf = nodes.where("is_leaf").select("book_id", F.col("node_id").alias("leaf_id"), F.col("title").alias("leaf_title"), F.col("start_off").alias("leaf_start"), F.col("end_off").alias("leaf_end"), "start_page", "end_page")
    return overlaps(frags.select(*NODE, "kind", "start_off", "end_off"), leaf, "book_id", ("start_off", "end_off", "leaf_start", "leaf_end"))


def preflight(nodes: DataFrame, frags: DataFrame) -> DataFrame:
    """(book_id, missing, title): books whose fragments touch leaves without pages, how many, and the first one's title.

    Such a book can't be exported before its structure is made anew, and is told so before any bracket is written.
    """
    bad = _met_leaves(nodes, frags).where("start_page is null or end_page is null").select("book_id", "leaf_id", "leaf_start", "leaf_title").distinct()
    return bad.groupBy("book_id").agg(F.count("*").alias("missing"), F.min(F.struct("leaf_start", "leaf_id", "leaf_title")).alias("x")).select("book_id", "missing", F.col("x.leaf_title").alias("title"))


def fragment_pages(nodes: DataFrame, frags: DataFrame) -> DataFrame:
    """(book_id, node_id, kind, start_off, lo, hi): pages from the first to the last of the leaves that overlap a fragment."""
    x = _met_leaves(nodes, frags).where("start_page is not null and end_page is not null")
    return x.groupBy(*NODE, "kind", "start_off").agg(F.min("start_page").alias("lo"), F.max("end_page").alias("hi"))


def deletions(pages: DataFrame, page_count: DataFrame, offset: int = 0) -> DataFrame:
    """(book_id, node_id, lo, hi): runs of pages to delete, each owned by the leftmost bracket on it; kept pages win.

    ``pages`` as of ``fragment_pages``; ``page_count`` is (book_id, page_count) and bounds what is spread out. ``offset``: pages
    of the file before the first one that was analysed; those are never deleted.
    """
    p = pages.join(page_count.where("page_count is not null"), "book_id")
    lo, hi = F.greatest(F.col("lo") + offset, F.lit(1 + offset)), F.least(F.col("hi") + offset, F.col("page_count"))
    each = p.where(lo <= hi).select(*NODE, "kind", "start_off", F.explode(F.sequence(lo, hi)).alias("page"))
    kept = F.max(F.when(F.col("kind") == "keep", 1).otherwise(0))
    owner = F.min(F.when(F.col("kind") == "bracket", F.struct("start_off", "node_id")))
    page = each.groupBy("book_id", "page").agg(kept.alias("kept"), owner.alias("o"))
    own = page.where("kept = 0").select("book_id", F.col("o.node_id").alias("node_id"), "page")
    run = F.col("page") - F.row_number().over(Window.partitionBy(*NODE).orderBy("page"))
    return own.withColumn("run", run).groupBy(*NODE, "run").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).select(*NODE, "lo", "hi")


def export_plan(nodes: DataFrame, inclusion: DataFrame, books: DataFrame, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The merged fragments, and the runs of pages to delete."""
    f = checkpointed(merged(fragments(nodes, inclusion)))
    b = books.where("page_count is not null").groupBy("book_id").agg(F.max("page_count").alias("page_count"))
    return f, deletions(fragment_pages(nodes, f), b, offset)


def export_stats(nodes: DataFrame, inclusion: DataFrame, books: DataFrame, offset: int = 0) -> DataFrame:
    """(book_id, pages, deleted, kept, brackets, exportable): what an edition leaves out of every book with a page count.

    ``brackets`` counts those that own a page; ``exportable``: every leaf that a fragment touches has its pages.
    """
    nodes = checkpointed(nodes.drop("summary_text"))
    f, gone = export_plan(nodes, inclusion, books, offset)
    b = books.where("page_count is not null").groupBy("book_id").agg(F.max("page_count").alias("page_count"))
    d = gone.groupBy("book_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("deleted"), F.count_distinct("node_id").alias("brackets"))
    x = b.join(d, "book_id", "left").join(preflight(nodes, f).select("book_id", "missing"), "book_id", "left")
    cut = F.coalesce("deleted", F.lit(0))
    return x.select("book_id", F.col("page_count").alias("pages"), cut.alias("deleted"), (F.col("page_count") - cut).alias("kept"), F.coalesce("brackets", F.lit(0)).alias("brackets"), F.col("missing").isNull().alias("exportable"))


#: What stands for a bracket that wasn't written; characters of a line and lines of a page of a rendered bracket.
UNAVAILABLE, LINE, LINES = "[Editorial bracket unavailable.]", 84, 42


def edit_plan(deleted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(book_id, step, node_id, lo, hi, title, text, inserted): the edits of each file from the last page to the first.

    In this order the places of earlier edits stay right. ``texts`` is (book_id, node_id, text); a bracket without one has
    a stand-in. ``inserted``: pages of the wrapped text, with a line for the title on each.
    """
    t = texts.groupBy(*NODE).agg(F.max("text").alias("text"))
    n = nodes.select(*NODE, F.coalesce("title", F.lit("Excluded section")).alias("title"))
    x = deleted.join(n, NODE, "left").join(t, NODE, "left").withColumn("text", F.coalesce("text", F.lit(UNAVAILABLE)))
    x = x.withColumn("title", F.coalesce("title", F.lit("Excluded section")))
    step = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("lo"), "node_id"))  # runs of one book's pages
    pages = F.greatest(F.lit(1), F.ceil(F.size(wrapped(F.col("text"), LINE)) / (LINES - 1))).cast("int")
    return x.select("book_id", step.alias("step"), "node_id", "lo", "hi", "title", "text", pages.alias("inserted"))


def toggled(nodes: DataFrame, inclusion: DataFrame, chosen: DataFrame) -> DataFrame:
    """Inclusion after toggling the nodes of ``chosen`` (book_id, node_id): a fully included subtree goes out, else it comes in."""
    s = states(nodes, inclusion).join(chosen.select(*NODE).distinct(), NODE, "left_semi").select(*NODE, (F.col("state") != "all").alias("to"))
    under = descendant_leaves(nodes).join(s, NODE).groupBy("book_id", "leaf_id").agg(F.bool_or("to").alias("to"))
    return leaf_inclusion(nodes, inclusion).join(under, ["book_id", "leaf_id"], "left").select("book_id", "leaf_id", F.coalesce("to", "included").alias("included"))


def applied(nodes: DataFrame, inclusion: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, leaf_id, included, before): inclusion after leaving out all leaves under ``excluded``, with the snapshot."""
    out = descendant_leaves(nodes).join(excluded.select(*NODE).distinct(), NODE, "left_semi").select("book_id", "leaf_id").distinct().withColumn("gone", F.lit(True))
    return leaf_inclusion(nodes, inclusion).join(out, ["book_id", "leaf_id"], "left").select("book_id", "leaf_id", (F.col("included") & F.col("gone").isNull()).alias("included"), F.col("included").alias("before"))


def set_to(nodes: DataFrame, inclusion: DataFrame, chosen: DataFrame) -> DataFrame:
    """Inclusion after setting all leaves under the nodes of ``chosen`` (book_id, node_id, to); of several orders leaving out wins."""
    under = descendant_leaves(nodes).join(chosen.groupBy(*NODE).agg(F.bool_and("to").alias("to")), NODE).groupBy("book_id", "leaf_id").agg(F.bool_and("to").alias("to"))
    return leaf_inclusion(nodes, inclusion).join(under, ["book_id", "leaf_id"], "left").select("book_id", "leaf_id", F.coalesce("to", "included").alias("included"))


def reverted(state: DataFrame) -> DataFrame:
    """The snapshot taken by ``applied``."""
    return state.select("book_id", "leaf_id", F.col("before").alias("included"))


def spine_plan(blocks: DataFrame, nodes: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(book_id, spine_item_id, leaves, replaced): a spine item is replaced where every leaf on its pages is left out.

    Leaves and items meet by an equi-join on (book, page); an item that no leaf reaches is kept.
    """
    item = blocks.where("spine_item_id is not null").select("book_id", "page_no", "spine_item_id").distinct()
    last = item.groupBy("book_id").agg(F.max("page_no").alias("last"))  # no leaf is spread over more pages than its book has
    inside = nodes.where("is_leaf and start_page <= end_page").join(last, "book_id").select("book_id", F.col("node_id").alias("leaf_id"), F.greatest("start_page", F.lit(1)).alias("lo"), F.least("end_page", "last").alias("hi")).where("lo <= hi")
    leaf = inside.select("book_id", "leaf_id", F.explode(F.sequence("lo", "hi")).alias("page_no")).join(leaf_inclusion(nodes, inclusion), ["book_id", "leaf_id"])
    hit = item.join(leaf, ["book_id", "page_no"]).select("book_id", "spine_item_id", "leaf_id", "included").distinct().groupBy("book_id", "spine_item_id").agg(F.count("*").alias("leaves"), F.bool_or("included").alias("any_kept"))
    return item.select("book_id", "spine_item_id").distinct().join(hit, ["book_id", "spine_item_id"], "left").select("book_id", "spine_item_id", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce(~F.col("any_kept"), F.lit(False)).alias("replaced"))
