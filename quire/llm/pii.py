"""Problem 9: personal data in free text, found by a linear-chain conditional random field and replaced.

The field is trained at start-up from the small table of ``labelled`` (sentences with marked spans) on features of word
shape: of each word, and of the run it stands in (something written like a mail address, groups of figures, figures mixed
with capitals). It is decoded by Viterbi in numpy batches. An exact check follows each decoded span: it is snapped to the
written form of its kind (an address with its at-sign, a number from its first to its last digit) or, where it has no
such form, dropped. Nothing is added that the field didn't find.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chain import Chain
from quire.llm.labelled import FAMILY, GIVEN, KINDS, LABELLED, ZH_FAMILY, realised

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "address": "[ADDRESS]", "person": "[PERSON]"}
LABELS = ["O", *(f"{x}-{k}" for k in KINDS.values() for x in "BI")]

#: Tokens that a decoded sequence labels at most, and tokens beyond it on both sides that it also looks at: longer texts are
#: decoded in overlapping sequences, each token labelled by the one that has the fuller context.
SEQUENCE, CONTEXT = 400, 60
#: Texts decoded together; sequences of like length share a numpy batch.
CALL = 768

# Words that announce or make up a kind of span, by kind of word.
LEXICON = {
    "street": "street lane road row terrace close yard avenue place square court drive st rd ave rue quai impasse boulevard allée chemin cours calle callejón plaza avda avenida paseo camino ronda straße strasse weg gasse platz promenade allee ufer ring speicher ул улица пер переулок наб набережная пр проспект бульвар 街 路 巷 町 坂 通 道",
    "unit": "flat apt apartment floor room suite unit bis ter n.º º piso puerta étage appt кв д дом корп 号 室 楼 丁目 番地 階",
    "title": "mr mrs ms dr prof st sir lady frau herr hr fr mme mlle m madame monsieur sr sra srta don doña г-н г-жа профессор",
    "mail": "mail e-mail email courriel correo почта 邮箱 メール ईमेल البريد อีเมล proofs épreuves pruebas fahnen 校样 校正刷り",
    "call": "tel call phone tél rappelez llame rückruf звоните тел 电话 電話 फ़ोन هاتف โทร office",
    "ident": "id ssn nie dni passport passeport paspoort identity insurance social security ausweis ausweisnummer steuer-id pièce documento documento документ паспорт 证件 身份证 個人番号 番号 identité sécurité",
    "org": "library trust press company chapel institute co ltd gmbh & verlag museum society university bibliothek archiv",
    "notid": "isbn shelfmark order request catalogue volume vol page pp usd tokens version model bestell commande pedido заказ",
    "greet": "regards sincerely cordialement saludo grüßen уважением name nom nombre имя 氏名 姓名 cc editor 联系 担当 連絡先",
}
LEX = {w: k for k, ws in LEXICON.items() for w in ws.split()}
LEX |= {w.lower(): "given" for w in GIVEN} | {w.lower(): "family" for w in FAMILY} | {c: "zhfam" for c in ZH_FAMILY}

#: How many fillings of each labelled sentence are trained on (twice as many of those made of loose words).
FILLINGS = 14
ROUNDS, RATE, RIDGE = 6, 0.08, 0.6

# Scripts by their blocks: Han and kana one by one; Latin, Greek and Cyrillic words; runs of other scripts with their marks.
_TOKEN = re.compile(r"[^\S\n]*(?:\n+|[\u3040-\u30ff\u3400-\u9fff々\uf900-\ufaff]|[A-Za-zªºÀ-ÖØ-öø-ʯͰ-ԯḀ-ỿ]+(?:['’][A-Za-zªºÀ-ÖØ-öø-ʯͰ-ԯḀ-ỿ]+)*|[\u0590-\u1dff\ua000-\ud7ff]+|[0-9０-９]+|\S)")


def tokens(text: str) -> tuple[list[str], list[int], list[int], dict[str, list[tuple[int, int]]]]:
    """Forms (with a leading blank after white space and the shape of their run behind a mark), starts, ends, and the runs."""
    raw = _TOKEN.findall(text)
    bare = [w.lstrip() or "\n" for w in raw]
    ends = list(accumulate(map(len, raw)))
    starts = [e - (len(w) if w != "\n" else len(r.lstrip(_BLANK))) for e, w, r in zip(ends, bare, raw, strict=True)]
    forms = [" " + _plain(w) if r is not w and r != w and w != "\n" else _plain(w) for r, w in zip(raw, bare, strict=True)]
    if forms and forms[0][0] not in " \n":
        forms[0] = " " + forms[0]
    runs = {"mail": _mails(text), "figures": [m.span() for m in _FIGURES.finditer(text)]}
    shaped = [(a, b, "mail") for a, b in runs["mail"]]
    shaped += [(a, b, tag) for a, b in runs["figures"] if (tag := _figures(text[a:b]))]
    shaped += [(m.start(), m.end(), tag) for m in _MIXED.finditer(text) if (tag := _mixed(m.group()))]
    for a, b, tag in shaped:
        for i in range(bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)):
            forms[i] += "\x1f" + tag
    return forms, starts, ends, runs


def _mails(text: str) -> list[tuple[int, int]]:
    """What is written like a mail address: each is looked for around its own at-sign."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        lo = m.start()
        if lo and text[lo - 1].isspace():
            lo -= 1
        floor = out[-1][1] if out else 0
        while lo > floor and (text[lo - 1] in "._+%-" or text[lo - 1].isascii() and text[lo - 1].isalnum()):
            lo -= 1
        while lo < m.start() and not text[lo].isalnum():
            lo += 1
        hit = _EMAIL.match(text, lo)
        if hit and hit.end() > m.end():
            out.append(hit.span())
    return out


def _plain(w: str) -> str:
    """A number by its length and first figure only; other forms as they are."""
    return (w[0] if w[0] in "01" else "7") + "7" * min(len(w) - 1, 11) if w[0].isdecimal() and w.isdecimal() else w


def _figures(run: str) -> str:
    """Shape of groups of figures: how it begins, how many figures, the groups; empty for short ones."""
    groups = re.findall(r"\d+", run)
    n = sum(map(len, groups))
    return f"fig|{run[0] if run[0] in '+(0' else 'x'}|{min(n, 20)}|{'-'.join(str(len(g)) for g in groups[:7])}" if n >= 6 else ""


def _mixed(run: str) -> str:
    """Shape of capitals and figures in one word: A for capitals, 9 for figures."""
    n = sum(c.isdigit() for c in run)
    return "mix|" + re.sub(r"9+", "9", re.sub(r"\d", "9", re.sub(r"[A-Z]+", "A", run)))[:12] + f"|{min(n, 12)}" if 4 <= n < len(run) and re.search("[A-Z]", run) else ""


#: White space without the line end.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n")


def form_features(form: str) -> list[str]:
    """Features of a form: its shape, ends and dictionary class, and the shape of the runs it stands in."""
    form, *tags = form.split("\x1f")
    sp = form[0] == " "
    w = form.strip(" ")
    out = ["b", "s" if sp else "n"]
    for tag in tags:
        part = tag.split("|")
        out += [f"run={'|'.join(part[:k])}" for k in range(1, len(part) + 1)]
        if part[0] == "fig":
            out.append(f"n={part[2]}")
    low = w.lower()
    c = w[:1]
    if c.isdigit():
        n = len(w)
        out += [f"d{min(n, 9)}", f"d{min(n, 9)}{'s' if sp else 'n'}", "num"]
        if w[0] == "0":
            out.append("zero")
        if n == 4 and w[0] == "1":
            out.append("year")
        return out
    if not c.isalpha():
        out += ["w=" + w, "w=" + w + ("s" if sp else "n"), "punct"]
        return out
    out.append("w=" + low)
    if low in LEX:
        out.append("lex=" + LEX[low])
    o = ord(c)
    if 0x3000 <= o < 0xA000:
        out.append("cjk")
        return out
    if o >= 0x590 and o < 0x1E00:
        out.append("script")
        return out
    shape = "X" if len(w) == 1 and c.isupper() else "XX" if w.isupper() else "Xx" if c.isupper() else "x"
    out += ["sh=" + shape, "sh=" + shape + ("s" if sp else "n"), "cyr" if 0x400 <= o < 0x530 else "lat"]
    if len(w) > 3:
        out += ["p=" + low[:3], "q=" + low[-3:]]
        if shape == "Xx":
            out += ["Q=" + low[-4:], "P=" + low[:4]]
    return out


def labelled() -> tuple[list[list[str]], list[list[str]]]:
    """The labelled table as token sequences and label sequences; most sentences stand between others, as in running text."""
    rng = random.Random(7)
    plain = [realised(rng, line) for line in LABELLED for _ in range(FILLINGS * (2 if "<w>" in line or "<w" in line and "{" in line else 1))]
    seqs, tags = [], []
    for own in plain:
        some = [own]
        if rng.random() < 0.75:
            some.insert(0, rng.choice(plain))
        if rng.random() < 0.3:
            some.append(rng.choice(plain))
        text, spans = "", []
        for part, marks in some:
            text += rng.choice([" ", " ", "\n"]) if text else ""
            spans += [(s + len(text), e + len(text), k) for s, e, k in marks]
            text += part
        if rng.random() < 0.12:  # printed lines
            text = "".join("\n" if c == " " and rng.random() < 0.15 else c for c in text)
        forms, starts, ends, _ = tokens(text)
        lab = ["O"] * len(forms)
        for s, e, kind in spans:
            first = True
            for i in range(bisect.bisect_right(ends, s), bisect.bisect_left(starts, e)):
                lab[i] = ("B-" if first else "I-") + kind
                first = False
        seqs.append(forms)
        tags.append(lab)
    return seqs, tags


@functools.lru_cache(maxsize=1)
def model() -> Chain:
    """The field, trained from the labelled table (a few seconds, the same everywhere)."""
    barred = [(a, f"I-{k}") for k in KINDS.values() for a in LABELS if a not in (f"B-{k}", f"I-{k}")]
    seqs, tags = labelled()
    return Chain(LABELS, form_features, barred).fit(seqs, tags, rounds=ROUNDS, rate=RATE, ridge=RIDGE, least=2)


_AT = r"(?:\s?@\s?|\s?[\[(]at[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
_EMAIL = regex.compile(rf"(?i)[a-z0-9][a-z0-9._+%-]*{_AT}\n?[a-z0-9-]+(?:{_DOT}\n?[a-z0-9-]+)*{_DOT}[a-z]{{2,}}")
_SIGN = re.compile(r"@|[\[(][Aa][Tt][\])]")
_FIGURES = re.compile(r"[+(]?\d[\d\s()./–-]*\d")
_MIXED = re.compile(r"(?<![\w-])(?=[A-Z-]*\d)[A-Z0-9]+(?:-[A-Z0-9]+)*(?![\w-])")
_IDNUM = regex.compile(r"[A-Z0-9]+(?:[ \n./-]{1,2}[A-Z0-9]+)*")


_UNIT = regex.compile(r"(?i),\s(?:apt|apartment|flat|floor|room|unit|suite|кв)\.?\s\d+\w?\b|,\s\d+º\s\p{Lu}\b|\d*[号室]")


def check(text: str, kind: str, s: int, e: int, runs: dict[str, list[tuple[int, int]]]) -> tuple[int, int] | None:
    """The exact check after decoding: the written form of ``kind`` at the span, or None; ``runs`` as of ``tokens``."""
    if kind == "email":
        return next(((a, b) for a, b in runs["mail"] if a < e and b > s), None)
    if kind == "phone":
        for a, b in runs["figures"]:
            if b <= s or a >= e:
                continue
            m = _FIGURES.match(text, max(a, s) if text[max(a, s)] in "+(" or text[max(a, s)].isdigit() else a, b)
            if not m:
                continue
            a, b = m.span()
            while "\n\n" in text[a:b]:
                b = text.rindex("\n\n", a, b)
            figures = [c for c in text[a:b] if c.isdigit()]
            if 7 <= len(figures) <= 15 and len(set(figures)) > 1 and not regex.search(r"\p{L}-\n?$", text[max(0, a - 3) : a]):
                return a, b
        return None
    while s < e and not (text[s].isalnum()):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    if kind == "idnum":
        while s > 0 and text[s - 1].isascii() and text[s - 1].isalnum():
            s -= 1  # a number is the whole of its word
        while e < len(text) and text[e].isascii() and text[e].isalnum():
            e += 1
        m = _IDNUM.search(text, s, e)
        figures = [c for c in m.group() if c.isdigit()] if m else []
        return m.span() if len(figures) >= 5 and len(set(figures)) > 1 and not regex.search(r"\p{L}-\n?$", text[max(0, m.start() - 3) : m.start()]) else None
    part = text[s:e]
    if kind == "address":
        if not (any(c.isdigit() for c in part) and any(c.isalpha() for c in part)):
            return None
        more = _UNIT.match(text, e)
        return s, more.end() if more else e
    if regex.search(r"[\d@]", part) or e - s < 2:
        return None
    more = regex.match(r"-\n?\p{Lu}[\p{L}’']+", text, pos=e)
    if more and text[s:e][-1:].isalpha():
        e = more.end()  # a double-barrelled name
    comma = regex.search(r",\s+(?!\p{Lu}|\p{Lo})", text[s:e])
    if comma and text[s].isupper():
        e = s + comma.start()  # what follows a comma in a name is a given name
    comma = text.find(",", s, e)
    if comma > 0 and len(regex.findall(r"\p{Lu}[\p{L}.’'-]*", text[s:comma])) > 1:
        e = comma  # a whole name before the comma: what follows is something else
    part = text[s:e]
    if regex.match(r"\p{Lu}\s", part):
        return None
    initials = regex.search(r"(?:(?<![\p{L}.])\p{Lu}\.\s){1,3}$", text[max(0, s - 10) : s])
    if initials:
        s -= len(initials.group())
    if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", part):
        return (s, e) if e - s <= 9 and not regex.search(r"[\p{P}\p{S}]", part) else None
    return (s, e) if regex.search(r"\p{L}[\s.,]+\p{L}{2,}", part) else None


def find_spans(texts: list[str | None], memo: dict | None = None, net: Chain | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every span of each text, in order; null and empty texts have none."""
    net = net or model()
    seqs, where, marks = [], [], []
    for k, t in enumerate(texts):
        if not t:
            marks.append(None)
            continue
        forms, *rest = tokens(t)
        marks.append((rest, np.zeros(len(forms), int)))
        for lo in range(0, len(forms), SEQUENCE):
            a = max(0, lo - CONTEXT)
            seqs.append(forms[a : lo + SEQUENCE + CONTEXT])
            where.append((k, lo, lo - a))
    for (k, lo, skip), path in zip(where, net.decode(seqs, memo), strict=True):
        whole = marks[k][1]
        own = path[skip : skip + SEQUENCE]
        whole[lo : lo + len(own)] = own
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, mark in enumerate(marks):
        if mark is None or not mark[1].any():
            continue
        (starts, ends, runs), path = mark
        i, n = 0, len(path)
        while i < n:
            if path[i] and path[i] % 2 == 1:
                j = i + 1
                while j < n and path[j] == path[i] + 1:
                    j += 1
                kind = LABELS[path[i]][2:]
                hit = check(texts[k], kind, starts[i], ends[j - 1], runs)
                if hit and not (out[k] and hit[0] < out[k][-1][2]):
                    out[k].append((kind, *hit))
                i = j
            else:
                i += 1
    return out


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, kind, start_off, end_off) of every span; offsets in code points.

    Null, empty and blank texts have no spans; equal texts have equal spans; other columns are ignored. A narrow
    map without shuffle: the field's weights are the same constants on every worker.
    """

    net = model()  # trained here once; workers get the weights

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in parts:
            ids, texts = pdf.iloc[:, 0].tolist(), [t if isinstance(t, str) else None for t in pdf.iloc[:, 1]]
            rows = []
            for lo in range(0, len(texts), CALL):
                for i, spans in zip(ids[lo : lo + CALL], find_spans(texts[lo : lo + CALL], memo, net), strict=True):
                    rows += [(i, k, s, e) for k, s, e in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_off", "end_off"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, kind string, start_off bigint, end_off bigint")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with typed placeholders in place of its spans and otherwise unchanged."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found): every document with placeholders and the number of spans replaced; null stays null."""

    net = model()  # trained here once; workers get the weights

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in parts:
            texts = [t if isinstance(t, str) else None for t in pdf.iloc[:, 1]]
            spans = [x for lo in range(0, len(texts), CALL) for x in find_spans(texts[lo : lo + CALL], memo, net)]
            yield pd.DataFrame({"doc_id": pdf.iloc[:, 0], "text": [redact(t, x) for t, x in zip(texts, spans, strict=True)], "found": [len(x) for x in spans]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, text string, found int")
