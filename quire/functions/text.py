"""Scalar text functions as Column expressions; all stay in the JVM.

Lengths and offsets are code points. White space is ASCII white space, so that results don't depend on the regex
engine. A null text gives null, an empty one the empty result named in each function.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"
WS_CHARS = " \t\n\r\f\x0b"
_SPACES = re.compile(WS + "+")
# Control and direction marks that are dropped from texts handed to a model.
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"
# Upper bounds in characters of the length hints, and word budgets of each.
HINTS = [(1500, "one-line"), (7500, "short"), (30000, "medium")]
WORD_BUDGETS = {"one-line": 30, "short": 110, "medium": 380, "long": 1100}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int")))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def truncate_words(text: Column, most: int | Column) -> Column:
    """The first ``most`` words and an ellipsis; a text within the limit is only trimmed."""
    w = words(text)
    limit = most if isinstance(most, Column) else F.lit(most)
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(w, F.lit(1), limit), " "), "[,;: ]+$", ""), F.lit("…"))
    return F.when(F.size(w) <= limit, trimmed(text)).otherwise(cut)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def wrap_untrusted(text: Column, tag: str = "book_content") -> Column:
    """The cleaned text between tags; a closing tag inside it is neutralised."""
    safe = F.regexp_replace(strip_control(text), f"(?i)</{tag}", f"<\\\\/{tag}")
    return F.concat(F.lit(f"<{tag}>\n"), safe, F.lit(f"\n</{tag}>"))


def length_hint(chars: Column) -> Column:
    out = F.when(chars <= HINTS[0][0], HINTS[0][1])
    for most, name in HINTS[1:]:
        out = out.when(chars <= most, name)
    return out.otherwise(F.when(chars.isNotNull(), "long"))


def offset_annotate(text: Column, step: int = 1000) -> Column:
    """[OFFSET=i] before every ``step`` characters; a shorter text is unchanged."""
    marks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.concat(F.lit("[OFFSET="), i.cast("string"), F.lit("]"), F.substring(text, i + 1, F.lit(step))))
    return F.when(F.length(text) >= step, F.array_join(marks, "")).otherwise(text)


def sample_sentences(text: Column, count: int) -> Column:
    """Up to ``count`` evenly spaced sentences of 25 to 240 characters."""
    parts = F.filter(F.transform(F.split(text, f"(?<=[.!?]){WS}+"), trimmed), lambda s: F.length(s).between(25, 240))

    def picked(found: Column) -> Column:
        n = F.size(found)
        at = lambda i: F.floor((i + F.lit(0.5)) * n / F.lit(count)).cast("int")
        some = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(found, at(i) + 1))
        return F.when(n <= count, found).otherwise(some)

    # a variable of a lambda is evaluated once, an expression as often as it is named
    return F.when(text.isNotNull(), F.transform(F.array(parts), picked)[0])


def named_terms(text: Column) -> Column:
    """Up to 20 proper nouns, 10 numbers of four digits and 5 straight-quoted spans, each once, in this order."""
    bound, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)))
    proper = find(f"{bound}[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{end}")
    return F.concat(F.slice(proper, 1, 20), F.slice(find(f"{bound}[0-9]{{4}}{end}"), 1, 10), F.slice(find('"[^"\n]{1,160}"'), 1, 5))


def context_before(text: Column, offset: Column, paragraphs: int = 1, most: int = 600) -> Column:
    """The last paragraphs before ``offset``, clamped to their last characters; empty where there is nothing."""
    head = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(offset, F.lit(0))), f"{WS}+$", "")
    parts = F.split(head, f"\n{WS}*\n")
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - paragraphs + 1, F.lit(1)), F.lit(paragraphs)), "\n\n")
    return trimmed(F.right(trimmed(last), F.lit(most)))


def context_after(text: Column, offset: Column, paragraphs: int = 1, most: int = 600) -> Column:
    """The first paragraphs from ``offset`` on, clamped to their first characters."""
    tail = F.regexp_replace(F.substring(text, F.greatest(offset, F.lit(0)) + 1, F.length(text)), f"^{WS}+", "")
    first = F.array_join(F.slice(F.split(tail, f"\n{WS}*\n"), 1, paragraphs), "\n\n")
    return trimmed(F.substring(trimmed(first), 1, most))


def around(text: Column, lo: Column, hi: Column, reach: int = 240) -> Column:
    """Struct of the characters before ``lo`` and after ``hi``."""
    start = F.greatest(lo - reach, F.lit(0))
    return F.struct(F.substring(text, (start + 1).cast("int"), (lo - start).cast("int")).alias("before"), F.substring(text, (hi + 1).cast("int"), F.lit(reach)).alias("after"))


def section_slug(ord_: Column, title: Column) -> Column:
    """sec-NNN-slug of a 1-based order and a title; an empty slug is ``untitled``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.substring(slug, 1, 40)
    return F.format_string("sec-%03d-%s", ord_.cast("int"), F.when(slug == "", "untitled").otherwise(slug))


def preview(text: Column, most: int = 400) -> Column:
    n = F.length(text)
    return F.when(n > most, F.concat(F.substring(text, 1, most), F.lit("…["), (n - most).cast("string"), F.lit(" more chars]"))).otherwise(text)


def file_name(title: Column, suffix: str = "-short") -> Column:
    """A title as a file name: separators and controls become underscores, at most 80 characters."""
    return F.concat(F.substring(F.regexp_replace(F.coalesce(title, F.lit("book")), "[\\\\/\\x00-\\x1f]", "_"), 1, 80), F.lit(suffix))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def paragraphs_html(text: Column, fallback: str = "[omitted]") -> Column:
    """Escaped <p> elements of the blank-line-separated paragraphs; a blank text gives the fallback."""
    parts = F.filter(F.transform(F.split(text, f"\n{WS}*\n"), trimmed), lambda p: p != "")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) < 1, F.lit(f"<p>{fallback}</p>")).otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "\n"))


def wrapped(text: Column, width: int) -> Column:
    """Greedy word wrap to lines of ``width`` characters; a longer word has a line of its own. Linear in the text."""

    @F.pandas_udf("array<string>")
    def wrap(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            lines, line, n = [], [], -1
            for w in _SPACES.split(t):
                if not w:
                    continue
                if line and n + 1 + len(w) > width:
                    lines.append(" ".join(line))
                    line, n = [], -1
                line.append(w)
                n += 1 + len(w)
            return [*lines, " ".join(line)] if line else lines

        return texts.map(one)

    return wrap(text)


def duration_ms(text: Column) -> Column:
    """Milliseconds of durations such as 1m30s, 250ms or bare seconds; null for anything else."""
    ok = text.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|s|m|h))+$")
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?(?:ms|s|m|h))"), F.lit(1))
    num = lambda p: F.regexp_extract(p, r"^([0-9.]+)", 1).cast("double")
    one = lambda p: num(p) * F.when(p.endswith("ms"), 1.0).when(p.endswith("h"), 3600000.0).when(p.endswith("m"), 60000.0).otherwise(1000.0)
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a + one(p))).when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.expr("1.0") * 1000.0 * text.try_cast("double"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it; an expression is made again at each place and item."""
    return F.transform(F.array(value), then)[0]


def lenient_json(raw: Column) -> Column:
    """The JSON in a model's reply: all of it, a fenced block, the outermost object or array; null where there is none."""

    def valid(s: Column) -> Column:
        # inside brackets, as the parser takes a value with anything behind it; what begins with a fence fails, at the price of an exception
        one = let(F.concat(F.lit("["), s, F.lit("]")), lambda x: F.try_parse_json(x).isNotNull() & (F.json_array_length(x) == 1))
        return F.when(~F.startswith(s, F.lit("`")) & one & (trimmed(s) != "null"), s)

    def within(inner: Column) -> Column:
        def span(a: str, b: str) -> Column:
            place = F.struct(F.instr(inner, a).alias("lo"), (F.length(inner) - F.instr(F.reverse(inner), b) + 1).alias("hi"))
            return let(place, lambda x: F.when((x["lo"] > 0) & (x["hi"] > x["lo"]), inner.substr(x["lo"], x["hi"] + 1 - x["lo"])))

        return F.coalesce(valid(inner), let(span("{", "}"), valid), let(span("[", "]"), valid))

    fence = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    block = let(fence, lambda x: F.when(x == "", raw).otherwise(x))
    return F.coalesce(valid(raw), let(trimmed(F.when(F.instr(raw, "```") > 0, block).otherwise(raw)), within))
