"""Problem 6: texts cut off by a field limit or mid-transfer.

Intact values of a bounded sample are cut artificially to give positives; a hashed logistic regression is trained on
closing characters, punctuation and length-to-limit features and scores every record. An exact check follows: texts
that the project itself shortened to the word budget of their target length and closed with an ellipsis are no cases.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sentences import sentences
from quire.llm.text import hollow
from quire.session import checkpointed

#: Records of each kind that the classifier is trained on, at most; scoring covers all records.
SAMPLE = 3000
#: Longest training text that is sent to the driver (longer ones aren't sampled); scoring reads whole texts.
SAMPLE_CHARS = 4000
BITS = 18
# Word budgets by target length.
BUDGETS = {"one-line": 30, "short": 110, "medium": 380, "long": 1100}

_BENIGN = regex.compile(r"(?:[\s\p{Z}\p{Cf}]+|\*+|[⁰¹²³⁴-⁹†‡§]+|\[\d{1,3}\]|</?[A-Za-z][^<>\n]{0,30}>|[\p{So}\p{Sk}️]+|\((?:ed|eds|red|éd|n\.d\.[er])\.\))$")
_TERM = regex.compile(r"[.!?…।؟。！？｡]+[\"”’»」』)\]】»“]*$|[.!?…]\s»$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}’'-]+|[^\s\p{L}\p{M}\p{N}]")
_SPACELESS = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
_OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "„": "“", "[": "]"}


def peel(text: str) -> tuple[str, int]:
    """``text`` without what a whole text may carry behind its end (notes, marks, tags, white space), and how much."""
    n = 0
    while text:
        m = _BENIGN.search(text, max(0, len(text) - 40))
        if not m:
            break
        if not m.group().isspace():
            n += 1
        text = text[: m.start()]
    return text, n


_BRACKETS = regex.compile("[" + regex.escape("".join({*_OPEN, *_OPEN.values()}), special_only=False) + "]")


def _open_marks(text: str) -> str:
    """The mark of the innermost quotation or bracket that is left open at the end of the text."""
    stack: list[str] = []
    for c in _BRACKETS.findall(text):
        if stack and c == _OPEN.get(stack[-1]):
            stack.pop()
        elif c in _OPEN and not (c == "“" and "„" in stack):
            stack.append(c)
    return stack[-1] if stack else ""


def features(text: str, limit: bool) -> list[int]:
    """Hashed features of the end of ``text``; ``limit``: its length is one at which values pile up."""
    core, marks = peel(text)
    tail = core[-80:]
    term = _TERM.search(tail)
    script = "s" if _SPACELESS.search(tail[-12:]) else "w"
    body = tail[: term.start()] if term else tail
    toks = _WORD.findall(body)[-3:]
    last = toks[-1].lower() if toks else ""
    end = term.group() if term else ""
    kind = "none" if not term else "dots" if end.startswith(("...", "…")) else "dot" if end[0] == "." else "mark"
    gap = "gap" if term and body[-1:].isspace() else ""
    shape = "d" if last[:1].isdigit() else "i" if len(last) == 1 else "l" if last[:1].isalpha() else "p" + last
    names = [
        "b", f"k={kind}", f"k={kind}{gap}|{script}", f"sh={shape}|{kind}", f"lim={limit}|{kind}", f"lim={limit}", f"open={_open_marks(core)}|{kind}", f"m={min(marks, 2)}|{kind}",
        f"c={core[-1:]}", f"cc={core[-2:]}" if not (core[-1:].isalpha()) else "cc=l", f"end={end}|{shape[:1]}", f"len={min(len(toks), 3)}",
    ]
    if kind == "dot" or kind == "dots":
        names += [f"w={last}|{kind}{gap}", f"cap={toks[-1][:1].isupper() if toks else ''}|{len(last) < 4}|{kind}", f"e={end}"]
        if len(toks) > 1:
            names.append(f"ww={toks[-2].lower()}_{last}|{kind}")
    if script == "s":
        names += [f"g{n}={body[-n:]}|{kind != 'none'}" for n in (1, 2, 3, 4, 5, 6, 8)]
    raw = text[-12:]
    if raw[-1:] not in ".。" and not raw[-1:].isalpha():
        names += [f"r{n}={raw[-n:]}" for n in (1, 2, 3, 5)]
    return [zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in dict.fromkeys(names)]


SUFFIXES = ["", "", "", "", "", "", "", "", " [cut]", "…", "...", "\n", "  ", " ", "\\", '"}', "<br", "&am", "�", ",", "\\u00", "</", "[...]"]
BENIGN = ["", "", "", "", "", "", "", " *", "²", " [4]", "</p>", " 📖", " (ed.)", " ", "\n", "  ", "​"]


def _cut(rng: random.Random, text: str, limits: list[int]) -> str | None:
    """``text`` cut inside a sentence, with what a faulty transfer may append; None where there is no such place."""
    units = sentences(text, False)
    ends = {e for _, e in units}
    x = rng.random()
    fits = [k for k in limits if k < len(text)]
    if x < 0.25:
        inner = [m.end() for m in regex.finditer(r"[.!?…。！？।]+[”»」)]*", text) if m.end() not in ends and m.end() < len(text)]
        if not inner:
            return None
        k = rng.choice(inner)
    elif x < 0.45 and fits:
        k = rng.choice(fits)
    else:
        k = int(len(text) * rng.uniform(0.15, 0.99))
    k = max(1, k)
    if any(k <= e <= k + 1 for e in ends) and not text[:k].rstrip()[-1:].isalpha() or len(text[:k].rstrip()) in ends or k + 1 >= len(text.rstrip()):
        return None
    return text[:k] + rng.choice(SUFFIXES)


def looks_whole(text: str) -> bool:
    core, _ = peel(text)
    if regex.search(r"\p{Thai}$", core):
        return True
    return bool(_TERM.search(core[-20:])) and not regex.search(r"[\p{L}\p{N}](?:…|\.\.\.)$", core if not _SPACELESS.search(core[-8:]) else "")


def train(texts: list[str], limits: list[int], seed: int = 5) -> np.ndarray:
    """Weights of the hashed regression from sampled values and their artificial cuts; deterministic."""
    rng = random.Random(seed)
    lim = set(limits)
    rows: list[list[int]] = []
    ys: list[int] = []
    for t in texts:
        if hollow(t) or not looks_whole(t):
            continue
        base, _ = peel(t)
        whole = base + rng.choice(BENIGN) if rng.random() < 0.5 else t
        rows += [features(whole, len(whole) in lim), features(t, len(t) in lim)]
        ys += [0, 0]
        for _ in range(2):
            c = _cut(rng, base, limits)
            if c is not None:
                rows.append(features(c, len(c) in lim))
                ys.append(1)
    w = np.zeros(1 << BITS, np.float32)
    g2 = np.full(1 << BITS, 1e-2, np.float32)
    y = np.array(ys, np.float32)
    order = np.arange(len(rows))
    gen = np.random.default_rng(seed)
    for _ in range(6):
        gen.shuffle(order)
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            ids = np.concatenate([rows[i] for i in part]) if len(part) else np.zeros(0, int)
            own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            p = 1 / (1 + np.exp(-np.bincount(own, w[ids], len(part))))
            grad = np.bincount(ids, (p - y[part])[own], minlength=0)
            idx = np.unique(ids)
            gi = grad[idx].astype(np.float32) + 1e-4 * w[idx]
            g2[idx] += gi * gi
            w[idx] -= 0.3 * gi / np.sqrt(g2[idx])
    return w


def shortened(text: str, target: str | None) -> bool:
    """Whether the project itself cut a text to the word budget of its target length and closed it with an ellipsis."""
    core, _ = peel(text)
    return core.endswith("…") and target in BUDGETS and len(core.split()) == BUDGETS[target]


class Model:
    """The weights of the regression that aren't zero, small enough to travel with the tasks, and the piled lengths by kind."""

    def __init__(self, weights: np.ndarray, limits: dict[str, set[int]]):
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.values, self.limits, self.whole = weights[self.at], limits, None

    def __getstate__(self):
        return self.__dict__ | {"whole": None}

    def scores(self, kinds: list[str], texts: list[str]) -> np.ndarray:
        """The probability of each text that it is cut; one sum over the features of all texts of a batch."""
        if self.whole is None:
            self.whole = np.zeros(1 << BITS, np.float32)
            self.whole[self.at] = self.values
        rows = [features(t, len(t) in self.limits.get(k, ())) for k, t in zip(kinds, texts, strict=True)]
        sizes = [len(r) for r in rows]
        ids = np.fromiter((x for r in rows for x in r), np.int64, sum(sizes))
        return 1 / (1 + np.exp(-np.bincount(np.repeat(np.arange(len(rows)), sizes), self.whole[ids], len(rows))))

    def cut(self, kinds: list[str], texts: list[str | None], targets: list[str | None]) -> list[bool]:
        """Whether each value with content breaks off inside a word or sentence; hollow ones don't."""
        full = [i for i, t in enumerate(texts) if not hollow(t) and not shortened(t, targets[i])]
        out = [False] * len(texts)
        for i, p in zip(full, self.scores([kinds[i] for i in full], [texts[i] for i in full]), strict=True):
            out[i] = bool(p >= 0.5)
        return out


def items(brackets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_kind, rec_id, model, request, text, target_length): every record once, in one table that is then read as often as needed."""
    none = F.lit(None).cast("string")
    b = brackets.select(F.lit("bracket").alias("item_kind"), "rec_id", "model", F.col("deleted_text").alias("request"), F.col("bracket_text").alias("text"), "target_length")
    n = nodes.where("summary_text is not null").select(F.lit("summary").alias("item_kind"), "rec_id", F.col("summary_model").alias("model"), none.alias("request"), F.col("summary_text").alias("text"), none.alias("target_length"))
    return checkpointed(b.unionByName(n).dropDuplicates(["item_kind", "rec_id"]))


#: How many standard deviations, and times, a length must stand out from the lengths around it.
DEVIATIONS, TIMES, AROUND = 6.0, 4.0, 5


def piled_lengths(texts: DataFrame) -> DataFrame:
    """(item_kind, n): lengths at which values pile up, against what the lengths around them have on average.

    Counted over all rows with map-side combination; each length is laid out once beside its neighbours, so the test is one
    aggregate over distinct lengths. It is relative: the same at every size, and no length that stands out is left out.
    """
    n = texts.where(F.length("text") > 24).groupBy("item_kind", F.length("text").alias("n")).agg(F.count("*").alias("k"))
    laid = n.select("item_kind", F.col("n").alias("at"), "k", F.explode(F.sequence(F.col("n") - AROUND, F.col("n") + AROUND)).alias("n"))
    own = F.max(F.when(F.col("at") == F.col("n"), F.col("k")))
    x = laid.groupBy("item_kind", "n").agg(own.alias("k"), F.sum(F.when(F.col("at") != F.col("n"), F.col("k"))).alias("s"))
    mean = F.coalesce(F.col("s"), F.lit(0)) / (2.0 * AROUND)
    return x.where((F.col("k") > TIMES * mean) & (F.col("k") - mean > DEVIATIONS * F.sqrt(mean + 1))).select("item_kind", "n")


def fit(table: DataFrame) -> Model:
    """The regression, trained on a sample of SAMPLE records of each kind by hash, with the piled lengths of each kind.

    What the driver takes besides the sample are the piled lengths: at most one number for every TIMES distinct lengths.
    """
    limits: dict[str, set[int]] = {}
    for r in piled_lengths(table).collect():
        limits.setdefault(r.item_kind, set()).add(r.n)
    texts: list[str] = []
    for kind in ("bracket", "summary"):
        some = table.where((F.col("item_kind") == kind) & F.length("text").between(12, SAMPLE_CHARS)).select("text", F.xxhash64("rec_id").alias("h")).orderBy("h", "text").limit(SAMPLE)
        texts += [r[0] for r in some.collect()]
    return Model(train(texts, sorted({x for v in limits.values() for x in v})), limits)


def judged(brackets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_kind, rec_id, model, cut) of every record with content.

    Exact repeats of a record count once. Null, blank and stand-in values have no row; a null model is kept.
    """
    table = items(brackets, nodes)
    model = fit(table)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[[isinstance(t, str) and not hollow(t) for t in pdf["text"]]]
            cut = model.cut(list(pdf["item_kind"]), list(pdf["text"]), [g if isinstance(g, str) else None for g in pdf["target_length"]])
            yield pdf[["item_kind", "rec_id", "model"]].assign(cut=cut)

    return table.select("item_kind", "rec_id", "model", "text", "target_length").mapInPandas(run, "item_kind string, rec_id bigint, model string, cut boolean")


def shares(brackets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_kind, model, records, cut, share): how often each model's values are cut."""
    return judged(brackets, nodes).groupBy("item_kind", "model").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("records"))


def found(brackets: DataFrame, nodes: DataFrame) -> DataFrame:
    return judged(brackets, nodes).where("cut").select("item_kind", "rec_id")
