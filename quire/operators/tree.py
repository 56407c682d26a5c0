"""Trees of sections as adjacency tables: chains, descendants, roll-ups, seeding and reconciling of children.

Closures go level by level over (book, node, parent) alone until a level is empty, each level one equi-join over all
books; trees may be of any depth. Nodes whose parent is missing are roots of their own. Folds that depend on what was kept
before run over the children of one node, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.operators.intervals import latest
from quire.operators.ordered import following, numbered, running
from quire.session import checkpointed, shuffled

# The depth below which a node isn't divided further.
DEPTH = 6
#: Characters of a text per tile of its reading order, and pages per tile of what runs over them.
TILE, PAGES = 1 << 13, 512
COLUMNS = ["parent_id", "ord", "depth", "title", "start_off", "end_off", "start_page", "end_page", "is_leaf", "source", "summary_text", "summary_words"]
# Limits of decomposition in pages and characters, and the most children of a node.
LEAF_PAGES, MIN_CHARS, MIN_PAGES, MAX_CHILDREN, SNAP = 5, 7500, 3, 8, 400


def current(nodes: DataFrame) -> DataFrame:
    """The latest stored version of every node."""
    return latest(nodes, ["book_id", "node_id"], ["stored_at", "rec_id"], COLUMNS)


def _levels(first: DataFrame, step, nodes: DataFrame) -> DataFrame:
    """The union of ``first`` and what ``step`` makes of each level, until one is empty.

    Parents that form a circle would go on for ever; no path is longer than its book has nodes.
    """
    level = checkpointed(first)
    out, rows, longest, depth = level, level._rows, None, 0
    while True:
        level = checkpointed(step(level))
        if not level._rows:
            return shuffled(out, rows)
        out, rows, depth = out.unionByName(level), rows + level._rows, depth + 1
        if depth % 8 == 0:  # few trees are that deep: is there a circle?
            longest = longest or nodes.groupBy("book_id").count().agg(F.max("count")).first()[0]
            if depth >= longest:
                return shuffled(out, rows)


def title_chains(nodes: DataFrame, glue: str = " › ") -> DataFrame:
    """(book_id, node_id, chain): titles from the root to each node that a root reaches, whatever its depth."""
    n = nodes.select("book_id", "node_id", "parent_id", F.coalesce("title", F.lit("")).alias("title"))
    inner = n.where("parent_id is not null")

    def below(level: DataFrame) -> DataFrame:
        up = level.select("book_id", F.col("node_id").alias("parent_id"), F.col("chain").alias("above"))
        return inner.join(up, ["book_id", "parent_id"]).select("book_id", "node_id", F.concat("above", F.lit(glue), "title").alias("chain"))

    return _levels(n.where("parent_id is null").select("book_id", "node_id", F.col("title").alias("chain")), below, n)


def ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(book_id, node_id, anc_id): every node (or those of ``of``) with itself and all nodes above it."""
    n = nodes.select("book_id", "node_id", "parent_id")
    parents = n.where("parent_id is not null").select("book_id", F.col("node_id").alias("anc_id"), F.col("parent_id").alias("next"))
    first = (n if of is None else of).select("book_id", "node_id", F.col("node_id").alias("anc_id"))
    return _levels(first, lambda level: level.join(parents, ["book_id", "anc_id"]).select("book_id", "node_id", F.col("next").alias("anc_id")), n)


def descendant_leaves(nodes: DataFrame) -> DataFrame:
    """(book_id, node_id, leaf_id) of every node and each leaf at or below it."""
    up = ancestors(nodes, nodes.where("is_leaf"))
    return up.select("book_id", F.col("anc_id").alias("node_id"), F.col("node_id").alias("leaf_id"))


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """(book_id, node_id, leaves, chars): leaves below each node and its own extent."""
    c = descendant_leaves(nodes).groupBy("book_id", "node_id").agg(F.count("*").alias("leaves"))
    return nodes.join(c, ["book_id", "node_id"], "left").select("book_id", "node_id", F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.col("end_off") - F.col("start_off")).alias("chars"))


def leaf_flags(nodes: DataFrame) -> DataFrame:
    """(book_id, node_id, stop): whether a node isn't to be divided further: deep, of few pages, or small."""
    size = F.col("end_off") - F.col("start_off")
    pages = F.coalesce(F.col("end_page") - F.col("start_page") + 1, F.ceil(size / 2500))
    return nodes.select("book_id", "node_id", ((F.col("depth") >= DEPTH) | (pages <= LEAF_PAGES) | (size < MIN_CHARS)).alias("stop"))


def listing(nodes: DataFrame) -> DataFrame:
    """(book_id, pos, node_id, chain, chars): nodes in reading order, with their chains and extents."""
    order = [F.col("start_off").asc_nulls_last(), "depth", "node_id"]
    n = nodes.select("book_id", "node_id", "depth", "start_off", (F.col("end_off") - F.col("start_off")).alias("chars"))
    n = n.join(title_chains(nodes), ["book_id", "node_id"])
    return numbered(n, ["book_id"], F.floor(F.col("start_off") / TILE), order, "pos").select("book_id", "pos", "node_id", "chain", "chars")


def downstream_leaves(nodes: DataFrame, most: int = 80) -> DataFrame:
    """(book_id, node_id, leaf_id, pos): for each inner node the first ``most`` leaves that start at or after its end.

    Leaves are numbered by start; the first number behind a node comes from a running count over starts and ends laid
    out together, and the ``most`` numbers from there meet the leaves by an equi-join. No pairs beyond those are made.
    """
    leaves = nodes.where("is_leaf and start_off is not null").select("book_id", F.col("node_id").alias("leaf_id"), "start_off")
    places = numbered(leaves, ["book_id"], F.floor(F.col("start_off") / TILE), ["start_off", "leaf_id"], "pos")
    none = F.lit(None).cast("string")
    ends = nodes.where("not is_leaf and end_off is not null").select("book_id", "node_id", F.col("end_off").alias("at"), F.lit(0).alias("one"))
    both = ends.unionByName(leaves.select("book_id", none.alias("node_id"), F.col("start_off").alias("at"), F.lit(1).alias("one")))
    counted = running(both, ["book_id"], F.floor(F.col("at") / TILE), ["at", "one"], F.col("one"), "before").where("one = 0")
    first = counted.select("book_id", "node_id", F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + most).cast("int"))).alias("pos"))
    return first.join(places, ["book_id", "pos"]).select("book_id", "node_id", "leaf_id", "pos")


def dependency_edges(nodes: DataFrame, most: int = 80) -> DataFrame:
    """(book_id, node_id, leaf_id): of the first leaves behind an inner node those whose title shares a longer word with its own."""
    terms = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-zà-ÿ]+"), lambda w: F.length(w) > 4)
    t = nodes.select("book_id", "node_id", terms.alias("terms"))
    pairs = downstream_leaves(nodes, most).join(t, ["book_id", "node_id"]).join(t.select("book_id", F.col("node_id").alias("leaf_id"), F.col("terms").alias("others")), ["book_id", "leaf_id"])
    return pairs.where(F.arrays_overlap("terms", "others")).select("book_id", "node_id", "leaf_id")


def seed_top_level(bounds: DataFrame, index: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(book_id, title, start_off, end_off): ranges of a book's text from its boundaries; small ones join the one before.

    The first range is stretched to the book's start, the last to its end; boundaries without text are dropped.
    """
    total = index.groupBy("book_id").agg(F.max(F.col("start") + F.col("chars")).alias("total"))
    pages = index.select("book_id", "page_no", "start")
    x = following(bounds.join(pages, ["book_id", "page_no"]), ["book_id"], F.floor(F.col("page_no") / PAGES), ["page_no", "title"], F.col("start"), "next")
    x = x.join(total, "book_id").select("book_id", "title", "start", F.coalesce("next", "total").alias("stop"), "total").where("stop > start")
    large = F.when(F.col("stop") - F.col("start") >= least, 1).otherwise(0)
    x = running(checkpointed(x), ["book_id"], F.floor(F.col("start") / TILE), ["start", "title"], large, "run", own=True)
    g = x.groupBy("book_id", "total", "run").agg(F.min(F.struct("start", "title")).alias("a"), F.max("stop").alias("stop"))
    ends = g.groupBy("book_id").agg(F.min("run").alias("first"), F.max("run").alias("last"))
    start = F.when(F.col("run") == F.col("first"), 0).otherwise(F.col("a.start")).cast("long")
    stop = F.when(F.col("run") == F.col("last"), F.col("total")).otherwise(F.col("stop"))
    return g.join(ends, "book_id").select("book_id", F.col("a.title").alias("title"), start.alias("start_off"), stop.alias("end_off"))


def _nearby(text: Column, offset: Column, reach: int) -> tuple[Column, Column, Column]:
    """Where the text within ``reach`` of ``offset`` begins, that text, and the offset's place in it."""
    lo = F.greatest(offset - reach, F.lit(0)).cast("int")
    hi = F.least(offset + reach, F.length(text)).cast("int")
    near = F.substring(text, lo + 1, F.greatest(hi - 1, lo) + 2 - lo)  # cut out once, as places in a long text are counted from its start
    return lo, near, F.coalesce(offset - lo, F.lit(0)).cast("int")


def _blank_lines(near: Column, at: Column) -> tuple[Column, Column]:
    """The last blank line up to ``at`` and the first one from there on; null where there is none."""
    head = F.reverse(F.substring(near, F.lit(1), at + 2))
    back, on = F.position(F.lit("\n\n"), head), F.position(F.lit("\n\n"), near, F.greatest(at + 1, F.lit(1)))
    return F.when(back > 0, F.length(head) - 1 - back), F.when(on > 0, on - 1)


def _nearest(lo: Column, at: Column, before: Column, after: Column, offset: Column) -> Column:
    best = F.when(after.isNull() | (at - before <= after - at), before).otherwise(after)
    return F.coalesce(lo + best + 2, offset).cast("int")


def snapped(text: Column, offset: Column, reach: int = SNAP) -> Column:
    """The end of the blank line nearest to ``offset`` within ``reach`` characters (ties: the earlier); else ``offset``."""
    lo, near, at = _nearby(text, offset, reach)
    return _nearest(lo, at, *_blank_lines(near, at), offset)


def reconciled(proposed: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, title, start_off, end_off): children as proposed for a text made contiguous, snapped and capped.

    ``proposed``: (id, title, start_off, end_off); ``texts``: (id, text). Bounds are clamped, empty ranges dropped; each
    child starts where the one before ends; interior ends snap to blank lines; the last reaches the end of the text; over
    the most children the rest is one tail.
    """
    n = F.length("text")
    clamp = lambda c: F.least(F.greatest(F.floor(c).cast("int"), F.lit(0)), n)
    p = proposed.join(texts, "id").select("id", "text", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled section")).alias("title"), clamp(F.col("start_off")).alias("s"), clamp(F.col("end_off")).alias("e")).where("e > s")
    p = p.select("id", n.alias("n"), "s", "e", "title", snapped(F.col("text"), F.col("e")).alias("snap"))  # texts stay out of the sort
    w = Window.partitionBy("id").orderBy("s", "e", "title")
    p = p.select("id", "n", "title", F.row_number().over(w).alias("k"), F.when(F.lead("s").over(w).isNull(), F.col("n")).otherwise(F.col("snap")).alias("stop"))
    k = Window.partitionBy("id").orderBy("k")
    top = F.coalesce(F.max("stop").over(k.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # the end of the last one kept
    kept = p.select("id", "n", "title", "k", F.greatest(top, F.lit(0)).alias("start"), "stop").where("stop > start")
    out = kept.select("*", (F.row_number().over(k) - 1).alias("i"), F.count("*").over(Window.partitionBy("id")).alias("m")).where(F.col("i") < MAX_CHILDREN)
    tail = (F.col("i") == MAX_CHILDREN - 1) & (F.col("m") > MAX_CHILDREN)
    last = tail | (F.col("i") == F.col("m") - 1)
    return out.select("id", F.when(tail, "Remaining material").otherwise(F.col("title")).alias("title"), F.col("start").alias("start_off"), F.when(last, F.col("n")).otherwise(F.col("stop")).alias("end_off"))


def contiguous(kids: Column, text: Column) -> Column:
    """``reconciled`` for an array of (title, startOffset, endOffset) beside its text: array of (title, start_off, end_off).

    A missing end is the text's. All stays in one row, so neither texts nor children are shuffled.
    """
    child = "array<struct<title:string,start_off:int,end_off:int>>"

    def fitted(n: Column) -> Column:
        clamp = lambda c: F.least(F.greatest(c, F.lit(0)), n).cast("int")
        title = lambda c: F.coalesce(F.nullif(F.trim(c["title"]), F.lit("")), F.lit("Untitled section"))
        x = F.transform(kids, lambda c: F.struct(clamp(c["startOffset"]).alias("s"), clamp(F.coalesce(c["endOffset"], n)).alias("e"), title(c).alias("title")))
        x = F.sort_array(F.filter(x, lambda c: c["e"] > c["s"]))

        def near(c: Column) -> Column:  # each step is an item of its own, as what a lambda names twice is made twice
            lo, cut, at = _nearby(text, c["e"], SNAP)
            return F.struct(c["title"].alias("title"), c["e"].alias("e"), lo.alias("lo"), cut.alias("near"), at.alias("at"))

        def lines(c: Column) -> Column:
            before, after = (F.when(F.contains(c["near"], F.lit("\n\n")), x) for x in _blank_lines(c["near"], c["at"]))
            return F.struct(c["title"].alias("title"), c["e"].alias("e"), c["lo"].alias("lo"), c["at"].alias("at"), before.alias("before"), after.alias("after"))

        ends = F.transform(F.transform(x, near), lines)
        ends = F.transform(ends, lambda c: F.struct(c["title"].alias("title"), _nearest(c["lo"], c["at"], c["before"], c["after"], c["e"]).alias("stop")))
        plain = F.transform(x, lambda c: F.struct(c["title"].alias("title"), c["e"].alias("stop")))  # most texts have no blank line to look for
        ends = F.when(F.contains(text, F.lit("\n\n")), ends).otherwise(plain)
        ends = let(ends, lambda x: F.transform(x, lambda c, i: F.struct(c["title"].alias("title"), F.when(i == F.size(x) - 1, n).otherwise(c["stop"]).alias("stop"))))

        def kept(acc: Column, c: Column) -> Column:
            one = F.struct(c["title"].alias("title"), acc["top"].alias("start_off"), c["stop"].alias("end_off"))
            return F.when(c["stop"] > acc["top"], F.struct(c["stop"].alias("top"), F.concat(acc["out"], F.array(one)).alias("out"))).otherwise(acc)

        def capped(x: Column) -> Column:
            last, tail = lambda i: i == F.least(F.size(x), F.lit(MAX_CHILDREN)) - 1, lambda i: (i == MAX_CHILDREN - 1) & (F.size(x) > MAX_CHILDREN)
            some = F.slice(x, 1, MAX_CHILDREN)
            return F.transform(some, lambda c, i: F.struct(F.when(tail(i), "Remaining material").otherwise(c["title"]).alias("title"), c["start_off"].alias("start_off"), F.when(last(i), n).otherwise(c["end_off"]).alias("end_off")))

        none = F.struct(F.lit(0).alias("top"), F.array().cast(child).alias("out"))
        return let(F.aggregate(ends, none, kept, lambda acc: acc["out"]), capped)

    return let(F.length(text), fitted)


def _small(y: Column, least: int) -> Column:
    return y["hi"] - y["lo"] + 1 < least


def _spanned(first: Column, last: Column, title: Column) -> Column:
    return F.struct(first["lo"].alias("lo"), last["hi"].alias("hi"), title.alias("title"), first["a"].alias("a"), last["b"].alias("b"))


def _absorbed(x: Column, item: str, least: int) -> Column:
    """The children (lo, hi, title, a, b) of the array ``x`` of the type ``item``, small ones merged with the one before."""
    top = lambda acc: F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))
    put = lambda acc, y: F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(y))

    def step(acc: Column, y: Column) -> Column:
        absorbed = F.when(_small(top(acc), least), put(acc, _spanned(top(acc), y, y["title"]))).otherwise(F.concat(acc, F.array(y)))
        return F.when(F.size(acc) == 0, F.array(y)).when(_small(y, least), put(acc, _spanned(top(acc), y, top(acc)["title"]))).otherwise(absorbed)

    return F.aggregate(x, F.array().cast(item), step)


def _tail_joined(f: Column, least: int) -> Column:
    """A small last one joins the one before."""
    n = F.size(f)
    before = F.element_at(f, F.greatest(n - 1, F.lit(1)))
    tail = F.array(_spanned(before, F.element_at(f, -1), before["title"]))
    return F.when((n >= 2) & _small(F.element_at(f, -1), least), F.concat(F.slice(f, F.lit(1), F.greatest(n - 2, F.lit(0))), tail)).otherwise(f)


def merged_in_order(x: Column, least: int = MIN_PAGES) -> Column:
    """``merge_undersized`` for an array of (lo, hi, title, a, b) in the order of its offsets a..b, one row per node."""
    return let(_absorbed(x, "array<struct<lo:int,hi:int,title:string,a:int,b:int>>", least), lambda f: _tail_joined(f, least))


def merge_undersized(children: DataFrame, least: int = MIN_PAGES) -> DataFrame:
    """(id, title, lo, hi): children of a node in pages lo..hi, those under ``least`` pages merged into a neighbour.

    A small child joins the one before; a small predecessor is absorbed by the next, which keeps its own title; a small
    last one joins the one before. Offsets (start_off, end_off) are merged along where ``children`` has them.
    """
    offsets = [c for c in ("start_off", "end_off") if c in children.columns]
    a, b = offsets or (F.lit(None).cast("int"), F.lit(None).cast("int"))
    entry = F.struct(F.col("lo"), F.col("hi"), F.col("title"), (F.col(a) if offsets else a).alias("a"), (F.col(b) if offsets else b).alias("b"))
    rows = children.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    f = rows.select("id", _absorbed(F.col("x"), f"array<{rows.schema['x'].dataType.elementType.simpleString()}>", least).alias("f"))
    fixed = _tail_joined(F.col("f"), least)
    out = f.select("id", F.explode(fixed).alias("c"))
    more = [F.col("c.a").alias("start_off"), F.col("c.b").alias("end_off")] if offsets else []
    return out.select("id", "c.title", "c.lo", "c.hi", *more)


def summarize_tree(nodes: DataFrame, leaf_words: int = 12, node_words: int = 60, summarizer=None) -> DataFrame:
    """(book_id, node_id, summary): summaries rolled up from the leaves, one set-based step per level.

    ``summarizer(df)`` turns (book_id, node_id, text, most) into (book_id, node_id, summary); the default takes the first
    words, so that results are reproducible. A leaf's text is its stored summary, an inner node's those of its children
    in order. The lineage is cut after each level.
    """
    from quire.functions.text import truncate_words

    def first_words(df):
        return df.select("book_id", "node_id", truncate_words(F.col("text"), F.col("most")).alias("summary"))

    run = summarizer or first_words
    n = checkpointed(nodes.select("book_id", "node_id", "parent_id", "ord", "depth", "is_leaf", "summary_text"))
    leaf = n.where("is_leaf").select("book_id", "node_id", F.coalesce("summary_text", F.lit("")).alias("text"), F.lit(leaf_words).alias("most"))
    out = level = checkpointed(run(leaf))
    for depth in _depths(n):
        here = n.where((F.col("depth") == depth) & ~F.col("is_leaf")).select("book_id", "node_id")
        kids = n.join(out, ["book_id", "node_id"]).select("book_id", F.col("parent_id").alias("node_id"), "ord", F.col("node_id").alias("kid"), "summary")
        x = F.sort_array(F.collect_list(F.struct("ord", "kid", "summary")))
        text = kids.join(here, ["book_id", "node_id"], "left_semi").groupBy("book_id", "node_id")
        text = text.agg(F.array_join(F.transform(x, lambda y: y["summary"]), " ").alias("text"), F.lit(node_words).alias("most"))
        level = checkpointed(run(text))
        out = out.unionByName(level)
    return out


def _depths(nodes: DataFrame) -> list[int]:
    """The depths at which inner nodes stand, deepest first."""
    return sorted((r[0] for r in nodes.where("not is_leaf and depth is not null").select("depth").distinct().collect()), reverse=True)
