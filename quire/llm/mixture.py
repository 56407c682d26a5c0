"""Problem 8: documents of several sources combined to target shares of the total size in tokens.

Each source first takes as many whole copies of all its documents as fit; the rest is a Pareto order sample: documents
are ranked by the odds of a random number over the odds of their inclusion, and the first of them up to the size that is
missing are taken. The cut in that order is found by two rounds of histograms, so that no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZERS, token_count
from quire.session import checkpointed, met

#: Bins of a histogram round.
BINS = 4096


def sized(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n, weight) of the documents of the named sources: tokens, and one over the repeats of the text."""
    names = targets.select("source").where("source is not null").distinct()
    d = met(docs.select("doc_id", "source", "text"), names, ["source"], "left_semi").where(F.col("text").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    n = d.select("doc_id", "source", "h", token_count(F.col("text"), folder).alias("n"))
    n = checkpointed(n)
    again = n.groupBy("source", "h").agg(F.count("*").alias("k")).where("k > 1")
    return n.join(again, ["source", "h"], "left").select("doc_id", "source", F.col("n").cast("long").alias("n"), (1.0 / F.coalesce("k", F.lit(1))).alias("weight")).where("n > 0")


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, max_repeats, size, mass, whole, rest): copies of every document and the tokens to sample.

    Sources without documents leave their share to the others in proportion. Without ``total`` the mixture is the largest
    that meets all shares; with a larger one the sources at their cap give what they have.
    """
    sizes = docs.groupBy("source").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("weight")).alias("mass"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    x = t.join(sizes, "source")
    every = Window.partitionBy(F.lit(1))  # one row per source of the fixed table
    x = x.withColumn("part", F.col("share") / F.sum("share").over(every))
    goal = F.lit(float(total)) if total is not None else F.min(F.col("max_repeats") * F.col("size") / F.col("part")).over(every)
    want = F.least(F.floor(goal * F.col("part") + 0.5), F.col("max_repeats") * F.col("size"))
    x = x.withColumn("want", want)
    return x.select("source", "share", "max_repeats", "size", "mass", F.floor(F.col("want") / F.col("size")).cast("int").alias("whole"), (F.col("want") % F.col("size")).alias("rest"))


def _order(docs: DataFrame, plan_: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, n, q): the Pareto rank of each document of a source that needs a sample."""
    d = met(docs, plan_.where("rest > 0"), ["source"])
    u = (F.xxhash64(F.lit(seed), "source", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.least(F.greatest(F.col("rest") * F.col("weight") / F.col("mass"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return d.select("source", "doc_id", "n", "rest", (F.log(u) - F.log1p(-u) - F.log(p) + F.log1p(-p)).alias("q"))


def _narrow(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: ``rows`` with lo, width, rest into those surely taken and those of the bin with the cut."""
    b = rows.withColumn("bin", F.least(F.greatest(F.floor((F.col("q") - F.col("lo")) / F.col("width")), F.lit(0)), F.lit(BINS - 1)))
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = b.groupBy("source", "bin", "rest").agg(F.sum("n").alias("m")).select("source", "bin", "rest", "m", F.sum("m").over(w).alias("upto"))
    cut = hist.where("upto >= rest and upto - m < rest").select("source", F.col("bin").alias("cut"), (F.col("rest") - (F.col("upto") - F.col("m"))).alias("left"))
    x = met(b, cut, ["source"], "left")
    taken = x.where("cut is null or bin < cut").select("source", "doc_id", "n")
    again = x.where("bin = cut").select("source", "doc_id", "n", "q", F.col("left").alias("rest"), (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), (F.col("width") / BINS).alias("width"))
    return taken, again


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, folder: str = TOKENIZERS) -> DataFrame:
    """(source, doc_id, n_tokens, copies): the documents of the mixture and how often each is used.

    Documents with a null source, a source without target, or a null or empty text aren't in it; no document is used more
    than max_repeats times; the draw depends on the seed and the ids only. Empty tables give an empty mixture.
    """
    d = checkpointed(sized(docs, targets, folder))
    p = checkpointed(plan(d, targets, total))
    q = _order(d, p, seed).withColumn("lo", F.lit(-80.0)).withColumn("width", F.lit(160.0 / BINS))
    one, cut = _narrow(q)
    cut = checkpointed(cut)
    two, last = _narrow(cut)
    w = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    three = last.select("source", "doc_id", "n", "rest", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")).where("before + n / 2 <= rest").select("source", "doc_id", "n")
    sample = one.unionByName(two).unionByName(three).select("source", "doc_id", F.lit(1).alias("extra"))
    every = met(d, p.select("source", "whole"), ["source"])
    return every.join(sample, ["source", "doc_id"], "left").select("source", "doc_id", F.col("n").alias("n_tokens"), (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")).where("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, folder: str = TOKENIZERS) -> DataFrame:
    """(source, target_share, actual_share, documents, tokens, most_copies) of every source with a target."""
    m = mixture(docs, targets, total, seed, folder).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    x = t.join(m, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    every = Window.partitionBy(F.lit(1))  # one row per source of the fixed table
    return x.select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)).alias("actual_share"), "documents", "tokens", "most_copies")
