"""Problem 4: items over a size limit, cut at natural boundaries with a given overlap.

An item's text is parsed into a tree: headings nest by rank, list items by depth, markup elements by their tags; a leaf of
that structure is a paragraph, which has sentences, clauses, words and characters below it. Sibling subtrees are merged from the
bottom up to the limit, only with siblings of the same parent; only a node that is itself over the limit is descended
into. A piece begins the overlap before the end of the one before it, so consecutive pieces share exactly that many
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.sentences import sentences

#: Positions per tile of the interval join between leaves and blocks.
TILE = 1 << 13
#: Pages per tile of the running offsets.
PAGES = 512

# Words and marks that open headings, by rank: parts before chapters before sections.
_RANKS = [regex.compile(p) for p in (r"(?i)(?:part|book|volume|teil|partie|parte|livre|libro|часть|том)\b.{0,80}$", r"(?i)(?:chapter|kapitel|chapitre|capítulo|capitolo|глава)\b.{0,80}$|第.{1,6}[章回]", r"(?i)(?:section|§|abschnitt|sección|раздел)\s?.{0,80}$")]
_HASHES = regex.compile(r"(#{1,6})\s")
_NUMBERED = regex.compile(r"(\d{1,3}(?:\.\d{1,3})*)\.?\s+\p{Lu}.{0,78}$")
_PLAIN = regex.compile(r"\p{Lu}[^.!?…。！？।]{0,78}$")
_ITEM = regex.compile(r"(\s*)(?:[-*•‣]|\d{1,3}[.)]|\p{L}[.)])\s")
_TAG = regex.compile(r"\s*<(/?)(h[1-6]|p|li|ul|ol|div|section|article|blockquote|table|tr|dl|dd)\b[^>]*>", regex.I)
#: Ranks: # headings 1-6, then books, chapters, sections, numbered and plain headings; paragraphs and items lie below all.
_BOOK, _CHAPTER, _NUMBER, _LINE, _TEXT = 7, 8, 10, 20, 30


class Node:
    """A stretch [lo, hi) of a text and the parts it is made of, in order and without gaps."""

    __slots__ = ("lo", "hi", "kids", "kind", "rank")

    def __init__(self, lo: int, rank: int, kind: str):
        self.lo, self.hi, self.rank, self.kind, self.kids = lo, lo, rank, kind, []


def _rank(line: str, follows: bool) -> int | None:
    """The rank of a heading line, None for other lines; a plain one needs a line of its own that text follows."""
    t = line.strip()
    m = _HASHES.match(t)
    if m:
        return len(m.group(1))
    if not t or len(t) > 90 or _ITEM.match(line):
        m = _NUMBERED.match(t)
        return _NUMBER + m.group(1).count(".") if m and "." in m.group(1) and len(t) <= 90 else None
    for k, p in enumerate(_RANKS):
        if p.match(t):
            return _BOOK + k
    m = _NUMBERED.match(t)
    if m:
        return _NUMBER + m.group(1).count(".")
    return _LINE if follows and _PLAIN.match(t) else None


def tree(text: str) -> Node:
    """The structure of a text, read line by line in one pass: a stack of open nodes, closed by what ranks at least as high.

    A heading closes headings of its rank and below; a list item closes items of its depth and below; a tag opens a node
    that its closing tag ends. Lines of neither kind are paragraphs of the innermost open node.
    """
    root = Node(0, 0, "text")
    stack = [root]
    at = 0
    lines = text.split("\n")

    def close(rank: int, end: int) -> None:
        while len(stack) > 1 and stack[-1].rank >= rank:
            stack.pop().hi = end

    def opened(rank: int, kind: str) -> None:
        n = Node(at, rank, kind)
        stack[-1].kids.append(n)
        stack.append(n)

    for i, line in enumerate(lines):
        end = min(len(text), at + len(line) + 1)
        tag = _TAG.match(line)
        if not line.strip():
            pass  # a blank line belongs to what stands before it
        elif tag and stack[0] is root:
            name = tag.group(2).lower()
            rank = int(name[1]) if name[0] == "h" and name[1:].isdigit() else None
            if tag.group(1):  # a closing tag ends its element behind it
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].kind == "<" + name), None)
                if k is not None:
                    for n in stack[k:]:
                        n.hi = end
                    del stack[k:]
                else:
                    close(_TEXT, at)
                    opened(_TEXT, "paragraph")
            elif rank is not None:
                inside = max((k for k, n in enumerate(stack) if n.kind[0] == "<"), default=0)
                while len(stack) - 1 > inside and stack[-1].rank >= rank:
                    stack.pop().hi = at
                opened(rank, "heading")
            else:
                close(_TEXT, at)
                if f"</{name}" in line.lower():
                    opened(_TEXT, "paragraph")
                else:
                    opened(_TEXT - 1, "<" + name)
        else:
            inside = max((k for k, n in enumerate(stack) if n.kind[0] == "<"), default=0)
            rank = _rank(line, i + 1 < len(lines))
            item = _ITEM.match(line)
            if rank is not None:
                while len(stack) - 1 > inside and stack[-1].rank >= rank:
                    stack.pop().hi = at
                opened(rank, "heading")
            elif item:
                depth = _TEXT + 1 + len(item.group(1).expandtabs(4))
                while len(stack) - 1 > inside and (stack[-1].kind == "paragraph" or stack[-1].kind == "item" and stack[-1].rank >= depth):
                    stack.pop().hi = at
                opened(depth, "item")
            else:
                while len(stack) - 1 > inside and (stack[-1].kind == "paragraph" or stack[-1].kind == "item" and not line[:1].isspace()):
                    stack.pop().hi = at
                opened(1 << 20, "paragraph")
        at = end
    for n in stack:
        n.hi = len(text)
    return _tiled(root)


def _tiled(root: Node) -> Node:
    """Every node's own first lines become a part of it, and each part reaches to where the next begins."""
    todo = [root]
    while todo:
        n = todo.pop()
        if not n.kids:
            continue
        if n.kids[0].lo > n.lo:
            head = Node(n.lo, n.rank, "head")
            n.kids.insert(0, head)
        for a, b in zip(n.kids, n.kids[1:], strict=False):
            a.hi = b.lo
        n.kids[-1].hi = n.hi
        todo += n.kids
    return root


_GAP = regex.compile(r"\s+|[,;:，、；：][\"”’»」』)]*\s*|(?<=[-–—/])")
_CLAUSE = regex.compile(r"[;:—][\"”’»)]*\s+|[；：、，][”」』）]*")
_JOINS = regex.compile(r"\p{M}|\u200d|\ufe0f")


def _grow(cuts: list[int], lo: int, hi: int) -> list[tuple[int, int]]:
    out = []
    for c in cuts:
        if lo < c < hi:
            out.append((lo, c))
            lo = c
    out.append((lo, hi))
    return out


#: What the end of a piece may be, in order of how natural it is.
KINDS = ["heading", "paragraph", "sentence", "clause", "word", "character"]


def _inner(text: str, lo: int, hi: int, level: int) -> list[tuple[int, int]]:
    """Parts of the paragraph [lo, hi): 2 sentences, 3 clauses, 4 words."""
    if level == 2:
        return _grow([lo + s for s, _ in sentences(text[lo:hi])][1:], lo, hi)
    return _grow([m.end() for m in (_CLAUSE if level == 3 else _GAP).finditer(text, lo, hi)], lo, hi)


def _merged(parts: list[tuple[int, int, str]], limit: int) -> list[tuple[int, int, str]]:
    """Neighbouring parts of one parent merged while they fit; a part's kind is what stands at its start."""
    out = [parts[0]]
    for a, b, kind in parts[1:]:
        if b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def _cut(text: str, lo: int, hi: int, level: int, limit: int, kind: str) -> list[tuple[int, int, str]]:
    """Pieces of an oversized paragraph: its sentences, of oversized ones the clauses, then words, then characters."""
    if hi - lo <= limit:
        return [(lo, hi, kind)]
    if level > 4:
        out = []
        while hi - lo > limit:
            k = lo + limit
            while k > lo + 1 and _JOINS.match(text[k]):
                k -= 1  # a mark stays with its character
            out.append((lo, k, kind))
            lo, kind = k, "character"
        return [*out, (lo, hi, kind)]
    groups: list[tuple[int, int, str]] = []
    out: list[tuple[int, int, str]] = []

    def flush() -> None:
        if groups:
            out.extend(_merged(groups, limit))
            groups.clear()

    for a, b in _inner(text, lo, hi, level):
        own = kind if a == lo else KINDS[level]
        if b - a <= limit:
            groups.append((a, b, own))
        else:
            flush()
            out += _cut(text, a, b, level + 1, limit, own)
    flush()
    return out


def _pack(text: str, node: Node, limit: int, kind: str = "heading") -> list[tuple[int, int, str]]:
    """Pieces [start, end, kind of boundary at the start) of a node, each at most ``limit`` long.

    A node within the limit is one part. Of an oversized one each run of siblings within the limit is merged; an oversized
    child is descended into, and what it gives isn't merged with its siblings.
    """
    out: list[tuple[int, int, str]] = []
    todo: list[tuple[Node, str] | list[tuple[int, int, str]]] = [(node, kind)]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            out += _merged(x, limit)
            continue
        n, kind = x
        if n.hi - n.lo <= limit:
            out.append((n.lo, n.hi, kind))
        elif not n.kids:
            out += _cut(text, n.lo, n.hi, 2, limit, kind)
        else:
            steps: list = []
            for k, c in enumerate(n.kids):
                own = kind if k == 0 else "heading" if c.kind == "heading" else "paragraph"
                if c.hi - c.lo > limit:
                    steps.append((c, own))
                elif steps and isinstance(steps[-1], list):
                    steps[-1].append((c.lo, c.hi, own))
                else:
                    steps.append([(c.lo, c.hi, own)])
            todo += reversed(steps)
    return out


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """[start, end) of the pieces before the overlap, each with the kind of boundary it begins at."""
    return [x for x in _pack(text, tree(text), most - max(0, min(overlap, most // 2))) if x[1] > x[0]]


def split(text: str | None, most: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of ``text``, each at most ``most`` long, neighbours sharing ``overlap`` characters.

    A text within the limit is one piece, a null or empty one the piece [0, 0). An overlap that leaves no room is
    reduced to half the limit. The pieces cover the text.
    """
    if not text:
        return [(0, 0)]
    if len(text) <= most:
        return [(0, len(text))]
    overlap = max(0, min(overlap, most // 2))
    return [(max(0, a - overlap), b) for a, b, _ in cuts(text, most, overlap)]


def book_pages(blocks: DataFrame) -> DataFrame:
    """(book_id, page_no, text): the text of each page, of its body blocks that aren't blank; repeats count once."""
    b = blocks.where((F.col("classification") == "body") & F.col("text").rlike(r"\S")).select("book_id", "page_no", "block_idx", "text")
    x = F.sort_array(F.collect_set(F.struct("block_idx", "text")))
    return b.groupBy("book_id", "page_no").agg(F.array_join(F.transform(x, lambda y: y["text"]), "\n").alias("text"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(book_id, page_no, start, end): where each page lies in its book's text.

    Running sums of length + 1 at two levels (tiles of pages, pages), over rows without their texts, so that no window
    runs over all that one book has.
    """
    p = pages.select("book_id", "page_no", F.length("text").alias("n"), F.floor(F.col("page_no") / PAGES).alias("tile"))
    tile = p.groupBy("book_id", "tile").agg(F.sum(F.col("n") + 1).alias("tn"))
    run = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tile = tile.select("book_id", "tile", run("tn", Window.partitionBy("book_id").orderBy("tile")).alias("t0"))
    p = p.select("book_id", "tile", "page_no", "n", run(F.col("n") + 1, Window.partitionBy("book_id", "tile").orderBy("page_no")).alias("p0"))
    start = F.col("t0") + F.col("p0")
    return p.join(tile, ["book_id", "tile"]).select("book_id", "page_no", start.alias("start"), (start + F.col("n")).alias("end"))


def leaf_texts(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rec_id, text) of leaves by their offsets [start_off, end_off) in the book's text.

    Leaves meet the pages they overlap by an equi-join on (book, tile of offsets) without any text; the texts are joined
    to what is left by (book, page), which is how they are partitioned already. Where a leaf reaches beyond the text,
    what is there counts; a leaf without any text isn't in the result.
    """
    pages = book_pages(blocks.join(leaves.select("book_id").distinct(), "book_id", "left_semi"))
    at = page_offsets(pages)
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / TILE), F.floor((F.col(hi) - 1) / TILE)))
    bt = at.select("book_id", "page_no", "start", "end", F.floor(F.col("start") / TILE).alias("first_b"), tiles("start", "end").alias("tile"))
    total = at.groupBy("book_id").agg(F.max("end").alias("total"))  # no leaf is spread over more tiles than its book has
    inside = leaves.join(total, "book_id").select("rec_id", "book_id", F.greatest("start_off", F.lit(0)).alias("start_off"), F.least("end_off", "total").alias("end_off")).where("start_off < end_off")
    lt = inside.select("rec_id", "book_id", "start_off", "end_off", F.floor(F.col("start_off") / TILE).alias("first_l"), tiles("start_off", "end_off").alias("tile"))
    hit = lt.join(bt, ["book_id", "tile"]).where((F.col("start") < F.col("end_off")) & (F.col("end") > F.col("start_off")) & (F.col("tile") == F.greatest("first_b", "first_l")))
    lo, hi = F.greatest("start", "start_off"), F.least("end", "end_off")
    want = hit.select("rec_id", "book_id", "page_no", lo.alias("at"), (lo - F.col("start") + 1).cast("int").alias("skip"), (hi - lo).cast("int").alias("take"))
    part = want.join(pages, ["book_id", "page_no"]).select("rec_id", F.struct("at", F.col("text").substr(F.col("skip"), F.col("take")).alias("t")).alias("x"))
    return part.groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def oversized(sections: DataFrame, nodes: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, rec_id, text, most, over) of every item over the limit of its kind.

    Sections count by the length of raw_text, leaves by end_off - start_off; all stored versions count, exact repeats of
    a record once. Items with null text, offsets or limit aren't over it. The text of a leaf whose offsets meet none is null.
    """
    # at most one row per kind of item
    rows = limits.where(F.col("item_kind").isin("section", "leaf") & F.col("max_chars").isNotNull()).groupBy("item_kind").agg(F.min("max_chars").alias("most"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("over")).collect()
    lim = {r.item_kind: (r.most, r.over) for r in rows}

    def over(df: DataFrame, kind: str, size) -> DataFrame:
        most, overlap = lim.get(kind, (None, None))
        cols = [F.lit(kind).alias("item_kind"), F.lit(most).cast("int").alias("most"), F.lit(overlap).cast("int").alias("over")]
        return df.where(size > F.lit(most).cast("int")).select("*", *cols).dropDuplicates(["rec_id"])

    s = over(sections.select("rec_id", F.col("raw_text").alias("text")), "section", F.length("text"))
    leaf = over(nodes.where("is_leaf and end_off > start_off").select("rec_id", "book_id", "start_off", "end_off"), "leaf", F.col("end_off") - F.col("start_off"))
    text = leaf_texts(leaf, blocks)
    return s.select("item_kind", "rec_id", "text", "most", "over").unionByName(leaf.join(text, "rec_id", "left").select("item_kind", "rec_id", "text", "most", "over"))


def _spread(items: DataFrame, columns: list[str], schema: str, rows_of) -> DataFrame:
    """One map over oversized items: ``rows_of(kind, rec_id, text, most, over)`` gives the rows of one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [x for kind, rec, t, most, over in pdf.itertuples(index=False) for x in rows_of(kind, rec, t if isinstance(t, str) else "", int(most), int(over))]
            yield pd.DataFrame(rows, columns=columns)

    return items.mapInPandas(run, schema)


def pieces(sections: DataFrame, nodes: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, rec_id, piece_no, piece_start, piece_end, text) of every item over the limit of its kind (``oversized``).

    An oversized leaf whose offsets meet no text has the one empty piece [0, 0).
    """
    rows = lambda kind, rec, t, most, over: [(kind, rec, k, a, b, t[a:b]) for k, (a, b) in enumerate(split(t, most, over))]
    return _spread(oversized(sections, nodes, blocks, limits), ["item_kind", "rec_id", "piece_no", "piece_start", "piece_end", "text"], "item_kind string, rec_id bigint, piece_no int, piece_start bigint, piece_end bigint, text string", rows)


def cut_kinds(sections: DataFrame, nodes: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, boundary, cuts, longest): how many cuts stand at each kind of boundary, and the longest piece begun there."""

    def rows(kind, rec, t, most, over):
        return [(kind, boundary, b - a) for a, b, boundary in (cuts(t, most, over)[1:] if len(t) > most else [])]

    x = _spread(oversized(sections, nodes, blocks, limits), ["item_kind", "boundary", "size"], "item_kind string, boundary string, size int", rows)
    return x.groupBy("item_kind", "boundary").agg(F.count("*").alias("cuts"), F.max("size").alias("longest"))


def found(sections: DataFrame, nodes: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """The items that were cut into pieces."""
    return pieces(sections, nodes, blocks, limits).where("piece_no = 0").select("item_kind", "rec_id")
