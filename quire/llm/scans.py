"""Problem 5: noise in the text of scanned pages.

The lines of a page, in block order, are labelled by a linear-chain conditional random field as furniture (running
header, footer, page number), heading, body or break (a line whose last word is divided), from layout features and from
counts over the whole corpus: how often a line recurs in its book, and how often the joined and the hyphenated form of a
divided word occur. Misrecognised words are rare forms that a known confusion of glyphs turns into a frequent one.
Paragraphs are put together again from the labelled lines.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quire.llm.chain import Chain
from quire.llm.sentences import GOES_ON, MAY_END, MONTHS, split_line
from quire.session import BROADCAST_ROWS, checkpointed, met

LABELS = ["body", "heading", "furniture", "break"]
#: Marks at a line end that may divide a word (the last is the soft hyphen).
MARKS = "-‐‑¬=\u00ad"
# What recognition makes of a letter (left), and the letters it may have been (right).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "B"), ("¢", "c"), ("†", "t"), ("|", "i"), ("|", "l"), ("ɑ", "a"), ("ſ", "s"), ("€", "e"), ("@", "a"), ("$", "s"), ("!", "i"), ("ı", "i"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("m", "ni"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("U", "ll"), ("ii", "u"),
    ("l", "i"), ("i", "l"), ("I", "l"),
]
# Glyphs that are no part of a word of letters, with the letters they stand for.
ODD = {"0": "o", "1": "l", "5": "s", "6": "b", "¢": "c", "†": "t", "|": "i", "ɑ": "a", "ſ": "s", "€": "e", "@": "a", "$": "s", "ı": "i"}
_ODD_MIX = regex.compile(r"(?<=\p{L})[0156¢†|ɑſ€@$ı]|[0156¢†|ɑſ€@$ı](?=\p{L})")
#: A rare form is taken for another word that is so many times as frequent, and occurs so often at least.
RATIO, LEAST = 10, 4
_WORD = r"[\p{L}0156¢†|ɑſ€]+(?:['’][\p{L}0156¢†|ɑſ€]+)*"


# ---------------------------------------------------------------------------------------------------- words
_FIND = regex.compile(_WORD).findall
_SPLIT = regex.compile(f"(?<!\\p{{L}})(\\p{{L}}[\\p{{L}}0156¢†|ɑſ€]*+)[{MARKS}]\\s*?(?:\\n([\\p{{L}}0156¢†|ɑſ€]++)|$)")
_COMPOUND = regex.compile(r"(?<!\p{L})\p{L}++(?:-\p{L}++)+").findall


def block_words(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words that stand within a line, compounds written with a hyphen there, and divided words put together.

    A divided word proves nothing about how it is written; a half at the end of the block is no word.
    """
    joined: list[str] = []

    def take(m) -> str:
        head, tail = m.group(1), m.group(2)
        if tail:
            joined.extend([head + tail] if tail[0].islower() else [head, tail])
        return " "

    solid = _SPLIT.sub(take, text) if "\n" in text or text[-3:].rstrip()[-1:] in MARKS else text
    return _FIND(solid), _COMPOUND(solid) if "-" in solid else [], joined


def block_forms(body: DataFrame) -> DataFrame:
    """(rec_id, words, compounds, joined) of the blocks (rec_id, text): ``block_words`` of each, taken once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [block_words(t) for t in pdf["text"]]
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "words": [x[0] for x in found], "compounds": [x[1] for x in found], "joined": [x[2] for x in found]})

    return body.select("rec_id", "text").mapInPandas(run, "rec_id bigint, words array<string>, compounds array<string>, joined array<string>")


def word_counts(forms: DataFrame) -> DataFrame:
    """(word, n, seen) over all blocks: how often a form stands within a line, and with divided words joined."""
    kinds = F.explode(F.array(*[F.struct(F.col(c).alias("w"), F.lit(n).alias("n"), F.lit(seen).alias("seen")) for c, n, seen in (("words", 1, 1), ("compounds", 1, 0), ("joined", 0, 1))]))
    return forms.select(kinds.alias("x")).select(F.explode("x.w").alias("word"), "x.n", "x.seen").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def with_misread(forms: DataFrame, bad: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(rec_id, words array<string>): the blocks of ``forms`` that hold words of ``bad``, and which."""
    each = forms.select("rec_id", F.explode(F.array_distinct(F.concat("words", "joined"))).alias("word"))
    return met(each, bad.select("word").distinct(), ["word"], "left_semi", most).groupBy("rec_id").agg(F.sort_array(F.collect_set("word")).alias("words"))


#: Unbroken text of more characters isn't a word but something encoded, and has no variants.
LONGEST = 1000


def variants(word: str) -> list[str]:
    """What a form may have been before recognition: odd glyphs undone at once, then one further confusion."""
    if len(word) > LONGEST:
        return []
    bases = [word]
    if _ODD_MIX.search(word):
        plain = "".join(ODD.get(c, c) for c in word)
        bases = [plain]
        if "1" in word or "|" in word:
            bases += ["".join({"1": "i", "|": "l"}.get(c, ODD.get(c, c)) for c in word)]
        if word[:1] in "015|":
            bases += [b[:1].upper() + b[1:] for b in bases]
    out = dict.fromkeys(b for b in bases if b != word)
    for b in bases:
        for a, c in CONFUSIONS:
            at = b.find(a)
            while at >= 0:
                out[b[:at] + c + b[at + len(a) :]] = None
                at = b.find(a, at + 1)
    out.pop(word, None)
    return list(out)


@pandas_udf(ArrayType(StringType()))
def _variants(s: pd.Series) -> pd.Series:
    return s.map(lambda w: variants(w) if isinstance(w, str) and any(c.isalpha() for c in w) else [])


def misread(counts: DataFrame) -> DataFrame:
    """(word, meant): forms that were misrecognised and the word meant.

    Every distinct form is held against all its variants by one equi-join on the variant; of several the most frequent
    is meant. Ties go to the first in alphabetical order.
    """
    forms = counts.where((F.col("seen") > 0) & (F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    pairs = forms.select("word", F.col("seen").alias("own"), F.explode(_variants("word")).alias("variant"))
    known = counts.where("n > 1").select(F.col("word").alias("variant"), F.col("n").alias("m"))
    odd = F.col("word").rlike(r"\p{L}[¢†|ɑſ€]|[¢†|ɑſ€]\p{L}|\p{L}[0156]\p{L}|\p{Ll}[0156]|^[0156]\p{Ll}{2}")
    hit = pairs.join(known, "variant").where(F.when(odd, F.col("m") >= F.greatest(F.lit(2), F.col("own"))).otherwise((F.col("m") >= LEAST) & (F.col("m") >= RATIO * F.col("own"))))
    best = hit.groupBy("word").agg(F.min(F.struct((-F.col("m")).alias("k"), "variant")).alias("x")).select("word", F.col("x.variant").alias("meant"))
    rest = counts.where((F.col("seen") > 0) & odd & (F.length("word") >= 4) & F.col("word").rlike(r"[¢†|ɑſ€]|\p{L}{2}[0156]\p{L}{2}")).join(best, "word", "left_anti").select("word", F.lit(None).cast("string").alias("meant"))
    return best.unionByName(rest)


# ---------------------------------------------------------------------------------------------------- lines
def _key(text: Column) -> Column:
    """A short line without its numbers, marks and case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\s]", ""), r"\s+", ""))


def page_blocks(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page_no, title, b): the blocks of each page of pdf books in order, null and blank texts and exact repeats left out.

    The only shuffle of all texts; a page is small.
    """
    pdf = books.where(F.lower("book_format") == "pdf").groupBy("book_id").agg(F.max("title").alias("title"))
    b = blocks.select("book_id", "page_no", "block_idx", "rec_id", "classification", "text").where(F.col("text").rlike(r"\S")).join(pdf, "book_id")
    x = F.sort_array(F.collect_set(F.struct("block_idx", "rec_id", F.coalesce("classification", F.lit("")).alias("cls"), "text")))
    return b.groupBy("book_id", "page_no").agg(F.max("title").alias("title"), x.alias("b"))


def recurrences(pages: DataFrame) -> DataFrame:
    """(book_id, page_no, rec_id, gap, titled, numbered, plain) of short lines, without their texts.

    ``gap``: pages since the same line stood in the book last; ``titled``: it is the book's title or stands mainly on
    even pages; ``numbered``/``plain``: headers of the book with and without a number.
    """
    few = F.filter("b", lambda x: (F.length(x["text"]) <= 90) & ~F.contains(x["text"], F.lit("\n")) & x["cls"].isin("body", "header", "footer"))
    x = pages.select("book_id", "page_no", "title", F.explode(few).alias("x"))
    style = x.where("x.cls = 'header'").groupBy("book_id").agg(F.count_if(F.col("x.text").rlike(r"\d")).alias("numbered"), F.count_if(~F.col("x.text").rlike(r"\d")).alias("plain"))
    x = x.select("book_id", "page_no", "x.rec_id", _key(F.col("x.text")).alias("key"), _key(F.col("title")).alias("title")).where(F.length("key") >= 3)
    per = x.select("book_id", "key", "page_no").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "key").orderBy("page_no")
    all_of = Window.partitionBy("book_id", "key")
    evens, odds = F.count_if(F.col("page_no") % 2 == 0).over(all_of), F.count_if(F.col("page_no") % 2 == 1).over(all_of)
    per = per.select("book_id", "key", "page_no", (F.col("page_no") - F.lag("page_no").over(w)).alias("gap"), ((evens >= 2) & (evens >= odds)).alias("even"))
    y = x.join(per, ["book_id", "key", "page_no"]).join(style, "book_id", "left")
    return y.select("book_id", "page_no", "rec_id", "gap", (F.coalesce(F.col("title") == F.col("key"), F.lit(False)) | F.col("even")).alias("titled"), F.coalesce("numbered", F.lit(0)).alias("numbered"), F.coalesce("plain", F.lit(0)).alias("plain"))


_DIVIDED = "(?<![\\p{L}0156¢†|ɑſ€])([\\p{L}0156¢†|ɑſ€]++)-\r?\n([\\p{L}0156¢†|ɑſ€]+)"
_DIVIDED_END = "(?<![\\p{L}0156¢†|ɑſ€])([\\p{L}0156¢†|ɑſ€]++)-\\s*$"


def evidence(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(head, tail, proof) of every distinct pair of halves: which form the corpus knows.

    ``join``: the joined word is the more frequent; ``compound``: the hyphenated one; ``halves``: only both halves are
    words; ``none``: nothing is known.
    """
    pairs = lines.select("head", "tail").distinct()
    c = lambda name, n: counts.select(F.col("word").alias(name), F.col("n").alias(n))
    x = (
        pairs.withColumn("joined", F.concat("head", "tail")).withColumn("hyphened", F.concat("head", F.lit("-"), "tail"))
        .join(c("joined", "nj"), "joined", "left").join(c("hyphened", "nh"), "hyphened", "left").join(c("head", "na"), "head", "left").join(c("tail", "nb"), "tail", "left")
    )
    nj, nh = F.coalesce("nj", F.lit(0)), F.coalesce("nh", F.lit(0))
    proof = F.when((nh > 1) & (nh >= nj), "compound").when(nj > 1, "join").when(nh > nj, "compound").when((F.coalesce("na", F.lit(0)) > 3) & (F.coalesce("nb", F.lit(0)) > 3), "halves").otherwise("none")
    return x.select("head", "tail", proof.alias("proof"))


def _form(parts: tuple) -> list[str]:
    """Features of a line from what was gathered about it."""
    return [f"{i}={v}" for i, v in enumerate(parts) if v is not None] + [f"{i}&{j}={parts[i]}&{parts[j]}" for i, j in ((0, 1), (1, 2), (2, 3), (0, 4), (5, 6), (0, 2), (1, 4), (4, 7), (3, 4)) if parts[i] is not None and parts[j] is not None]


def _figures(text: str) -> str:
    return "".join({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "i": "1"}.get(c, c) for c in text)


def _roman(n: int) -> str:
    out = ""
    for v, c in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + c, n - v
    return out


def line_form(line: str, page: int, alone: bool, first: bool, last: bool, gap, folio: bool, numbered: int, plain: int, titled: bool, proof: str | None, mark: str | None) -> tuple:
    """What the field looks at: page number, place, shape, recurrence, style of the book, division."""
    t = line.strip()
    low = len(t)
    nums = [_figures(w) for w in regex.findall(r"(?<![\p{L}\d])[\dlIO|So]{1,4}(?![\p{L}\d])", t) if regex.search(r"\d|^[lI]$|^[lIO]{2,}$", w) and w not in ("II", "III", "I")] if alone and low <= 90 else []
    only = alone and bool(regex.fullmatch(r"(?i)[\W_]*(?:p\.|pp\.|page|pag\.|pág\.|s\.|seite|стр\.|с\.|第|หน้า|ص|पृ)?[\s–—-]*[\dlIO|So]+(?:\s*(?:of|von|de|sur|из|/|頁|页)\s*[\dlIO|So]+)?[\W_]*(?:頁|页)?", t)) and bool(nums)
    number = "none"
    if nums:
        number = "page" if str(page) in nums[:1] + nums[-1:] else "other"
    roman = alone and bool(regex.fullmatch(r"[ivxlcdm]+", t)) and t == _roman(page)
    shape = "only" if only else "roman" if roman else "orn" if alone and not any(c.isalnum() for c in t) else "short" if alone and low <= 90 and not regex.search(r"[.!?…。！？।]$", t) else "text"
    place = "top" if first else "bottom" if last else "mid"
    tail = "edge" if number == "page" and regex.search(r"(?:^\W*[\dlIO|]+\s{2,}|(?:\s{2,}|\|\s*)[\dlIO|]+\W*$)", t) else "in" if nums and shape == "short" else "no"
    back = ("never" if gap is None else "near" if gap <= 2 else "far") + ("even" if page % 2 == 0 else "odd")
    style = "plain" if plain > max(2, 0.5 * numbered) else "numbered" if numbered else "none"
    head = f"{style}{back}{titled}{folio}" if place == "top" and shape == "short" and number == "none" else None
    return (number, shape, place, back + ("t" if titled else ""), style, mark or "no", proof or "no", tail, head, f"{number}{shape}{place}")


@functools.lru_cache(maxsize=1)
def model() -> Chain:
    """The field, trained on the small labelled table of page layouts below."""
    rng = random.Random(11)
    seqs, tags = [], []
    body = lambda: line_form("They walked along the lane until", 9, False, False, False, None, False, 5, 0, False, None, None)

    def block(out, lab, where):
        n = rng.randint(1, 6)
        for k in range(n):
            div = rng.random() < 0.3
            mark = rng.choice(["-", "-", "-", "‐", "¬", "=", "\u00ad"]) if div else None
            proof = rng.choice(["join", "join", "join", "none", "compound", "halves"]) if div else None
            hit = bool(mark) and (proof in ("join", "none") or (mark != "-"))
            out.append(line_form("They walked along the lane until", 9, False, where == 0 and k == 0, where == 2 and k == n - 1, None, False, 5, 0, False, proof, mark))
            lab.append("break" if hit else "body")

    # Labelled lines: text with # for the page number, the style of the book's headers, pages since the text stood there
    # last, whether it is the book's title or belongs to even pages, whether the page has a number, parity; label.
    top = [
        ("#   THE PAPER LANTERN", "numbered", None, False, False, None, "furniture"), ("THE PAPER LANTERN   #", "numbered", None, False, True, None, "furniture"), ("#   THE PAPER LANTERN", "numbered", 2, True, False, 0, "furniture"),
        ("ON THE LONG ROAD   #", "numbered", 2, False, False, 1, "furniture"), ("The Paper Lantern   #", "none", 1, True, False, None, "furniture"), ("LES DEUX VALISES   #", "numbered", 1, False, False, None, "furniture"),
        ("EVENING WALKS   #", "numbered", None, False, False, 1, "furniture"), ("THE PAPER LANTERN   #", "plain", 1, False, False, None, "furniture"),
        ("THE PAPER LANTERN", "plain", 1, False, True, 1, "furniture"), ("The Paper Lantern", "plain", 2, True, True, 0, "furniture"), ("The Paper Lantern", "plain", 2, True, False, 0, "heading"), ("The Long Road", "plain", 2, False, True, 1, "furniture"),
        ("The Long Road", "plain", 1, False, False, 1, "heading"), ("The Long Road", "plain", 2, False, False, 1, "heading"), ("The Paper Lantern", "plain", None, True, False, 0, "heading"), ("The Paper Lantern", "plain", None, True, True, 0, "furniture"),
        ("The Paper Lantern", "plain", 7, True, True, 0, "furniture"), ("The Paper Lantern", "plain", 6, True, False, 0, "heading"), ("The Long Road", "plain", None, False, True, 1, "furniture"), ("The Long Road", "plain", 9, False, True, 1, "furniture"), ("The Long Road", "plain", None, False, True, 0, "furniture"),
        ("THE LONG ROAD", "plain", None, False, False, 1, "heading"), ("The Long Road", "plain", None, False, False, 0, "heading"), ("The Long Road", "plain", 9, False, False, 1, "heading"), ("The Long Road", "plain", 9, False, False, 0, "heading"),
        ("The Long Road", "plain", 1, False, False, 0, "heading"), ("The Long Road", "plain", 2, False, False, 0, "heading"), ("The Paper Lantern", "plain", None, True, False, 1, "heading"), ("The Paper Lantern", "plain", 5, True, False, 1, "heading"), ("The Paper Lantern", "plain", 1, True, False, 1, "heading"),
        ("ON THE LONG ROAD", "numbered", None, False, False, None, "heading"), ("On the Long Road", "numbered", None, False, False, None, "heading"), ("Das Gartentor", "none", None, False, False, None, "heading"), ("LA FENÊTRE VERTE", "numbered", 1, False, False, None, "heading"),
        ("LA FENÊTRE VERTE", "none", 2, False, False, None, "heading"), ("El reloj de agua", "numbered", 12, False, False, None, "heading"), ("LA FENÊTRE VERTE", "none", None, False, False, None, "heading"), ("Las barcas", "numbered", None, True, False, None, "heading"), ("Las barcas", "numbered", 2, True, False, 0, "heading"),
        ("Las barcas", "none", 2, True, False, 0, "heading"), ("Las barcas", "none", None, False, True, None, "heading"),
        ("The Paper Lantern", "plain", 2, True, True, 1, "furniture"), ("The Paper Lantern", "none", None, True, True, 0, "furniture"), ("The Paper Lantern", "none", 2, True, True, 0, "furniture"),
    ]
    foot = [
        ("Die Gartenlaube | #", "none", 1, True, False, None, "furniture"), ("DIE GARTENLAUBE | #", "numbered", None, False, False, None, "furniture"), ("On the Long Road | #", "none", None, False, False, None, "furniture"), ("La fenêtre verte | #", "plain", 2, False, False, None, "furniture"), ("p. #", "plain", None, False, False, None, "furniture"),
        ("#", "plain", None, False, False, None, "furniture"), ("#", "none", None, False, False, None, "furniture"), ("[#]", "plain", None, False, False, None, "furniture"), ("– # –", "none", None, False, False, None, "furniture"), ("– # –", "plain", None, False, False, None, "furniture"), ("Page # of 46", "plain", 1, False, False, None, "furniture"), ("Page # of 12", "numbered", 1, False, False, None, "furniture"),
        ("Page # of 12", "plain", None, False, False, None, "furniture"), ("~", "plain", None, False, False, None, "furniture"), ("~", "none", None, False, False, None, "furniture"), ("* * *", "numbered", None, False, False, None, "body"), ("1844", "plain", None, False, False, None, "body"), ("9,801", "none", None, False, False, None, "body"), ("III", "plain", None, False, False, None, "body"), ("4,685", "numbered", None, False, False, None, "body"),
    ]
    mid = [("* * *", "numbered", None, False, False, None, "body"), ("* * *", "plain", 1, False, False, None, "body"), ("1684", "numbered", None, False, False, None, "body"), ("9,572", "plain", None, False, False, None, "body"), ("III", "none", None, False, False, None, "body"), ("IV", "plain", None, False, False, None, "body"), ("1872", "none", None, False, False, None, "body"), ("The Long Road", "numbered", None, False, False, None, "heading")]
    styles = {"numbered": (9, 0), "plain": (0, 9), "none": (0, 0)}

    def put(item, where, out, lab):
        text, style, gap, titled, folio, parity, label = item
        page = rng.randint(1, 60) if text != "~" else rng.randint(1, 12)
        if parity is not None:
            page += (page + parity) % 2
        text = text.replace("~", _roman(page))
        n, p = styles[style]
        out.append(line_form(text.replace("#", str(page)), page, True, where == 0, where == 2, gap, folio, n, p, titled, None, None))
        lab.append(label)

    for _ in range(12):
        for t in top:
            for f in rng.sample(foot, 3) + [None, None]:
                out, lab = [], []
                if rng.random() < 0.75:
                    put(t, 0, out, lab)
                else:
                    block(out, lab, 0)
                block(out, lab, 1)
                if rng.random() < 0.3:
                    put(rng.choice(mid), 1, out, lab)
                    block(out, lab, 1)
                if f is None:
                    block(out, lab, 2)
                else:
                    put(f, 2, out, lab)
                seqs.append(out)
                tags.append(lab)
    return Chain(LABELS, _form, offsets=(-1, 0, 1)).fit(seqs, tags, rounds=6, ridge=1.0)


def divisions(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(book_id, page_no, rec_id, head, proof) of words divided by a hyphen at a line end; other marks need no proof."""
    body = F.filter("b", lambda x: F.contains(x["text"], F.lit("-\n")) | F.contains(x["text"], F.lit("-\r\n")))
    at = pages.select("book_id", "page_no", F.explode(body).alias("x")).select("book_id", "page_no", "x.rec_id", F.explode(F.regexp_extract_all("x.text", F.lit(_DIVIDED), F.lit(0))).alias("m"))
    inner = at.select("book_id", "page_no", "rec_id", F.regexp_extract("m", _DIVIDED, 1).alias("head"), F.regexp_extract("m", _DIVIDED, 2).alias("tail"))
    # a word divided at the end of a page goes on in the first body block of the next
    of_body = F.filter("b", lambda x: x["cls"] == "body")
    ends = pages.select("book_id", "page_no", F.explode(F.filter(of_body, lambda x: F.rtrim(x["text"]).endswith("-"))).alias("x")).select("book_id", F.col("page_no").alias("at"), (F.col("page_no") + 1).alias("page_no"), "x.rec_id", F.regexp_extract("x.text", _DIVIDED_END, 1).alias("head")).where("head <> ''")
    starts = pages.select("book_id", "page_no", F.regexp_extract(F.get(F.filter(of_body, lambda x: x["text"].rlike(r"^\p{Ll}")), F.lit(0))["text"], r"^(\p{L}+)", 1).alias("tail")).where("tail <> ''")
    over = ends.join(starts, ["book_id", "page_no"], "left").select("book_id", F.col("at").alias("page_no"), "rec_id", "head", F.coalesce("tail", F.lit("")).alias("tail"))
    both = inner.unionByName(over)
    return both.join(evidence(both, counts), ["head", "tail"]).select("book_id", "page_no", "rec_id", "head", "proof")


def labelled_lines(pages: DataFrame, counts: DataFrame, classes: tuple[str, ...] = ("body",), with_text: bool = False) -> DataFrame:
    """(rec_id, book_id, page_no, block_idx, text, labels array<string>) of the blocks of some classes; text on demand.

    What is known about lines is gathered per page without their texts and met by one join with the pages.
    """
    rec = recurrences(pages).select("book_id", "page_no", F.struct("rec_id", "gap", "titled", "numbered", "plain").alias("r"), F.lit(None).cast("struct<rec_id:bigint,head:string,proof:string>").alias("p"))
    div = divisions(pages, counts).select("book_id", "page_no", F.lit(None).cast(rec.schema["r"].dataType).alias("r"), F.struct("rec_id", "head", "proof").alias("p"))
    side = rec.unionByName(div).groupBy("book_id", "page_no").agg(F.collect_list("r").alias("r"), F.collect_set("p").alias("p"))
    page = pages.select("book_id", "page_no", "b").join(side, ["book_id", "page_no"], "left")
    net = model()
    end = regex.compile(f"(?<![\\p{{L}}])(\\p{{L}}[\\p{{L}}0156¢†|ɑſ€]*)([{MARKS}])\\s*$")
    number = regex.compile(r"(?i)^\W*(?:p\.|page)?\s*|\s*of \S+$|\W+$")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in parts:
            seqs, spans, out = [], [], []
            for book, no, bs, rs, ps in zip(pdf["book_id"], pdf["page_no"], pdf["b"], pdf["r"], pdf["p"], strict=True):
                seen = {x["rec_id"]: x for x in rs} if rs is not None else {}
                proofs: dict = {}
                for x in ps if ps is not None else ():
                    proofs.setdefault((x["rec_id"], x["head"]), x["proof"])
                folio = any(x["cls"] == "folio" or (len(x["text"]) <= 14 and number.sub("", x["text"]) == str(no)) for x in bs)
                lo, hi = bs[0]["block_idx"], bs[-1]["block_idx"]
                forms = []
                for x in bs:
                    if x["cls"] not in classes:
                        continue
                    lines = x["text"].replace("\r\n", "\n").split("\n")
                    s = seen.get(x["rec_id"])
                    gap, titled, numbered, plain = (None, False, 0, 0) if s is None else (s["gap"], s["titled"], s["numbered"], s["plain"])
                    start, alone, last = len(forms), len(lines) == 1, len(lines) - 1
                    for k, line in enumerate(lines):
                        m = end.search(line[-60:])
                        proof = (proofs.get((x["rec_id"], m.group(1))) or "none") if m else None
                        forms.append(line_form(line, no, alone, x["block_idx"] == lo and k == 0, x["block_idx"] == hi and k == last, gap, folio, numbered, plain, titled, proof, m.group(2) if m else None))
                    spans.append((len(seqs), start, len(forms)))
                    out.append((x["rec_id"], book, no, x["block_idx"], x["text"] if with_text else None))
                seqs.append(forms)
            paths = net.decode(seqs, memo)
            res = pd.DataFrame(out, columns=["rec_id", "book_id", "page_no", "block_idx", "text"])
            res["labels"] = [[LABELS[i] for i in paths[p][a:b]] for p, a, b in spans]
            yield res

    return page.mapInPandas(run, "rec_id bigint, book_id string, page_no int, block_idx int, text string, labels array<string>")


def _prepared(blocks: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages, the forms of their body blocks, and the word counts."""
    pages = checkpointed(page_blocks(blocks, books))
    body = pages.select(F.explode(F.filter("b", lambda x: x["cls"] == "body")).alias("x")).select("x.rec_id", "x.text")
    forms = checkpointed(block_forms(body))
    return pages, forms, checkpointed(word_counts(forms))


def cases(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(rec_id, noise): furniture, break and glyph cases of body blocks.

    Null and blank texts have no case; repeats of a record count once; books without rows in ``books`` are left out, as
    their format is unknown.
    """
    pages, forms, counts = _prepared(blocks, books)
    lines = labelled_lines(pages, counts)
    kinds = checkpointed(lines.select("rec_id", F.forall("labels", lambda x: x == "furniture").alias("furniture"), F.exists("labels", lambda x: x == "break").alias("broken")))
    a = kinds.where("furniture").select("rec_id", F.lit("furniture").alias("noise"))
    b = kinds.where("broken and not furniture").select("rec_id", F.lit("break").alias("noise"))
    c = with_misread(forms, misread(counts)).select("rec_id").join(kinds.where("furniture").select("rec_id"), "rec_id", "left_anti").select("rec_id", F.lit("glyph").alias("noise"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------------------------------------------- paragraphs
#: Classes that may stand between the two parts of a paragraph.
BETWEEN = ("body", "header", "footer", "folio", "footnote", "caption", "")
#: Body blocks up to this length may be headings or entries, and an open end of theirs says little, but for several
#: lines of FILLED characters on average, which neither headings nor most verses have.
SHORT, FILLED = 90, 35
#: Characters of each side that are looked at where two pages meet.
SEAM = 120
# Abbreviations that are also words a paragraph may end with.
_WORDS_TOO = {"no", "me", "art", "sec", "gen", "col", "op", "st", "o", "m", "s"}
_CLOSED = regex.compile(r"[.!?…。！？।؟｡][\"”“’»›」』)）\]]*$")
_ITEM = regex.compile(r"[•▪*–—-]\s|\(?(?:\d{1,3}|[a-z])\)\s|(?:\d{1,3}|[IVXLC]+)\.\s")


def goes_on(tail: str, head: str, long: bool, cut: bool, apart: bool) -> bool:
    """Whether the paragraph whose text ends in ``tail`` at the end of a page goes on in ``head`` on the next.

    ``long``: running text by its length and lines; ``cut``: the last word is divided; ``apart``: a heading or the like stands
    between, or ``tail`` looks like one. A small letter, comma or semicolon goes on where no sentence was closed; a capital, a figure, a quotation
    or a caseless script only where a long block, a divided word or a comma breaks off inside a sentence.
    """
    tail, head = tail.rstrip(), head.lstrip()
    small = bool(regex.match(r"[\p{Ll},;]", head))
    if not head or not tail or (apart and not small):
        return False
    if _CLOSED.search(tail):
        token = regex.search(r"(?<![\p{L}\p{M}.])([\p{L}\p{M}.\-]+)\.$", tail)
        low = token.group(1).lower() if token else ""
        if low not in GOES_ON and low not in MAY_END or len(tail) in split_line(f"{tail} {head}"):
            return False
        return small or (low in GOES_ON and (head[0].isdigit() or low not in _WORDS_TOO)) and long
    if small:
        return True
    if cut and head[0].isalpha():
        return True
    if not regex.search(r"\p{L}", head) or regex.match(r"[IVXLC]+\W*$", head):
        return False  # an ornament or a number
    day = regex.match(r"\d{1,2}\.\s+(\p{L}+)", head)
    if _ITEM.match(head) and not (day and day.group(1).lower() in MONTHS):
        return False
    if tail[-1] in ":：" or not (long or tail.rstrip("\"”“’»›」』")[-1:] in ",;،，、"):
        return False
    return not regex.search(r"\p{Thai}$", tail) or len(tail) not in split_line(f"{tail} {head}")


def paragraphs(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page_no, block_idx, text): continuous paragraphs without furniture, words restored.

    A block's lines are joined, divided words restored and misread words replaced by the word meant. A paragraph that
    goes on in the first block of the next page (``goes_on``) is one row under the block it starts in; chains of pages
    are resolved by doubling the pointers, so that no book is gathered in one task. Spaceless scripts are joined without
    a space there.
    """
    pages, forms, counts = _prepared(blocks, books)
    lines = checkpointed(labelled_lines(pages, counts, with_text=True).where(~F.forall("labels", lambda x: x == "furniture")))
    meant = checkpointed(misread(counts).where("meant is not null"))
    fixes = with_misread(forms, meant).select("rec_id", F.explode("words").alias("word")).join(meant, "word").groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("fix"))

    @pandas_udf("string")
    def repair(text: pd.Series, labels: pd.Series, fix: pd.Series) -> pd.Series:
        def one(t, lab, f):
            parts = t.replace("\r\n", "\n").split("\n")
            out = ""
            for k, line in enumerate(parts):
                cut = k < len(lab) and lab[k] == "break"
                line = line.rstrip()
                last = k == len(parts) - 1
                out += line.rstrip(MARKS) if cut and not last else line if last or line.endswith("-") else line + " "
            for a, b in dict(f or {}).items():
                out = regex.sub(rf"(?<!\p{{L}}){regex.escape(a)}(?!\p{{L}})", lambda _, b=b: b, out)
            return out

        return pd.Series([one(t, list(x), f) for t, x, f in zip(text, labels, fix, strict=True)])

    heading = F.exists("labels", lambda x: x == "heading")
    rows = lines.join(fixes, "rec_id", "left").select("rec_id", "book_id", "page_no", "block_idx", heading.alias("heading"), F.size("labels").alias("lines"), (F.element_at("labels", -1) == "break").alias("cut"), repair("text", "labels", "fix").alias("text"))
    rows = checkpointed(rows)
    edge = rows.groupBy("book_id", "page_no").agg(F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"))
    other = pages.select("book_id", "page_no", F.explode(F.filter("b", lambda x: ~x["cls"].isin(*BETWEEN))["block_idx"]).alias("at")).groupBy("book_id", "page_no").agg(F.min("at").alias("top"), F.max("at").alias("bottom"))
    ends = rows.join(edge.join(other, ["book_id", "page_no"], "left"), ["book_id", "page_no"])
    apart = lambda x: F.coalesce(x, F.lit(False))
    firsts = ends.where("block_idx = lo").select("book_id", "page_no", "block_idx", F.substring("text", 1, SEAM).alias("head"), (F.col("heading") | apart(F.col("top") < F.col("lo"))).alias("below"), (F.col("lo") == F.col("hi")).alias("single"))
    lasts = ends.where("block_idx = hi").select("book_id", (F.col("page_no") + 1).alias("page_no"), F.col("block_idx").alias("to_idx"), F.right("text", F.lit(SEAM)).alias("tail"), ((F.length("text") > SHORT) | (F.col("lines") > 1) & (F.length("text") >= FILLED * F.col("lines"))).alias("long"), "cut", (F.col("heading") | apart(F.col("bottom") > F.col("hi"))).alias("above"))

    @pandas_udf("boolean")
    def joins(tail: pd.Series, head: pd.Series, long: pd.Series, cut: pd.Series, apart: pd.Series) -> pd.Series:
        return pd.Series([goes_on(*x) for x in zip(tail, head, long, cut, apart, strict=True)], dtype=bool)

    hyphen = F.when(F.col("cut") & F.col("tail").rlike(r"-\s*$") & F.col("head").rlike(r"^\p{Lu}\p{Ll}"), "-").otherwise("")  # of a compound: Nord-Süd
    link = firsts.join(lasts, ["book_id", "page_no"]).where(joins("tail", "head", "long", "cut", F.col("below") | F.col("above"))).select("book_id", "page_no", "block_idx", "single", hyphen.alias("hyphen"), (F.col("page_no") - 1).alias("to_page"), "to_idx")
    link = checkpointed(link)
    while True:
        via = link.where("single").select("book_id", F.col("page_no").alias("to_page"), F.col("to_page").alias("p2"), F.col("to_idx").alias("i2"))
        step = link.join(via, ["book_id", "to_page"], "left")
        if step.where("p2 is not null").isEmpty():
            break
        link = checkpointed(step.select("book_id", "page_no", "block_idx", "single", "hyphen", F.coalesce("p2", "to_page").alias("to_page"), F.coalesce("i2", "to_idx").alias("to_idx")), frees=link)
    at = link.select("book_id", "page_no", "block_idx", "hyphen", "to_page", "to_idx")
    moved = rows.join(at, ["book_id", "page_no", "block_idx"], "left").select("book_id", F.coalesce("to_page", "page_no").alias("p"), F.coalesce("to_idx", "block_idx").alias("i"), "page_no", "block_idx", F.concat(F.coalesce("hyphen", F.lit("")), "text").alias("text"), "cut")
    parts = moved.groupBy("book_id", "p", "i").agg(F.sort_array(F.collect_list(F.struct("page_no", "block_idx", "text", "cut"))).alias("x"))
    spaceless = lambda x: x.rlike(r"[\p{IsThai}\p{IsHan}\p{IsHiragana}\p{IsKatakana}。，、」』]$")
    text = F.aggregate("x", F.lit(""), lambda acc, y: F.concat(acc, F.when(y["cut"], F.regexp_replace(y["text"], f"[{MARKS}]\\s*$", "")).when(spaceless(y["text"]), y["text"]).otherwise(F.concat(y["text"], F.lit(" ")))))
    return parts.select("book_id", F.col("p").alias("page_no"), F.col("i").alias("block_idx"), F.rtrim(text).alias("text"))
