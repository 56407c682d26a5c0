"""Problem 3: sentence units across languages and scripts.

Each line is a lattice: its nodes are the places where a sentence may end (terminators, gaps of spaceless scripts, the end
of the line), an edge is a unit between two of them, and the units of the cheapest path are the sentences. A terminator of
a spaced script is scored by what stands around it (abbreviation or number before, opening after, quotation, ellipsis); a
gap of a spaceless script (Thai, Chinese, Japanese) by the final particle before it and the opening, linking or reporting
word after it, which a dictionary word lattice over the whole run tells. An edge costs more where a unit would hold no
letter or figure, or would part a quotation from the words that report it.

The dictionary of the word lattice are the closed classes below and a lexicon that the engine counts over all texts.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpointed

# Abbreviations after which a sentence goes on, whatever follows.
GOES_ON = set(
    "cf p pp vol vols no nos nr nrn ch chs fig figs sec ed eds mr mrs ms dr prof st rev hon capt col gen sgt lt messrs approx ca circa vs viz i.e e.g e.i a.k.a op bd bde abb bzw "
    "evtl ggf vgl s hr fr sog z d h u o m mm mme mmes mlle mlles me mgr c.-à-d p.ex ex env art chap pág págs sr sra srta sres dra d.ª vid véase núm cap "
    "с стр см т тт рис гл им ул пер наб д ср напр п пп с.-п ص د أ م ق ج डॉ श्री पृ सं क्र".split()
)
# Abbreviations that may also close a sentence, when a capitalised opening follows.
MAY_END = set("etc usw usf u.s.w a.m p.m co inc ltd corp jr sr. v.l k.l.v и.т.д т.д т.п т.е г гг в вв др пр ff f a.d b.c a.c d.c u.s u.k e.u ee.uu".split())
# Months after an ordinal day.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
# Words that report a quotation, in scripts without capitals.
REPORTS = "पूछा कहा बोला बोली पूछी سأل قال قالت أجاب صاح ردّ هتف سألت ถาม กล่าว พูด ตอบ".split()
# Words that continue a sentence after suspension points.
CONTINUES = "ثم لكن و फिर पर और लेकिन แล้ว แต่ และ 后来 然后 接着 但 却 于是 而 それから そして しかし だが と って".split()
# Dictionary of the word lattice, by part: final particles and words, openers, links, units.
LATTICE = {
    "final": "吗 呢 吧 啊 嘛 啦 た だ です ます でした ました ません だった だろう でしょう のか か よ ね ない る ครับ ค่ะ คะ นะ จ้ะ แล้ว",
    "weak": "了 的 过 着 う",
    "open": "这 那 他 她 它 我 我们 他们 在 第二年 世纪末 年底 没有 尽管 歉收 围城 大桥 据 一 この その 彼 彼女 私 包囲 翌年 世紀 何 反対 凶作 年 しかし また ใน ก่อน หลัง ระหว่าง โดย เป็น เมื่อ แต่ละ ผู้ พ่อค้า คณะ สภา ช่าง หอ เสมียน อาราม เขา เธอ ฉัน เรา ต่อไป เรื่อง วันนี้ ครั้ง",
    "link": "和 与 而 但 并 或 以前 之前 之后 以后 は が を に で と の も へ から まで より แต่ และ หรือ ที่ ของ ให้ ว่า ซึ่ง จาก ถึง กับ って",
    "unit": "年 月 日 页 卷 章 里 亩 号 回 巻 頁 反 ฉบับ กก พ.ศ ค.ศ ปี น หน้า เล่ม ข้อ บาท เมตร",
    "report": "说 问 问道 说道 回答 答 答道 喊 喊道 道 叫 言い 言った 尋ねた 答えた 叫んだ ถาม กล่าว พูด ตอบ",
    "goes": "后来 然后 接着 却 于是 それから そして だが",
    "other": "知道 街道 河道 难道 小说 传说 学问 疑问 其他 现在 过了 目的 もう とても でも はい いる แผนที่ พื้นที่ หน้าที่ สถานที่ เจ้าหน้าที่ ทันที คำถาม คำตอบ",
}
WORDS = {w: k for k, ws in LATTICE.items() for w in ws.split()}
# The dictionary by first character: lengths of the words.
LENGTHS = {c: sorted({len(w) for w in WORDS if w[0] == c}) for c in {w[0] for w in WORDS}}
# What the class of the word before a gap, and of the word after it, says for the end of a sentence there.
BEFORE = {"final": 1.0, "weak": 0.5, "link": -2.0, "unit": -1.0}
AFTER = {"open": 1.0, "link": -1.0, "goes": -1.0}

CLOSERS = "”’»」』)]）］】〉》›"
OPENERS = "“‘«「『(（[［【〈《„¿¡‹"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "„": "“", "《": "》", "‹": "›"}

#: Characters that an abbreviation has at most, and an address on the web.
ABBREVIATION, ADDRESS = 40, 2048
# What speaks for (above 0) and against an end of a sentence at a terminator.
WEIGHTS = {
    "stop": 1.0, "mark": 1.5, "ellipsis": -0.5, "full": 2.0, "goes on": -8.0, "small": -4.0, "small name": 5.0, "abbreviation": -6.0, "initial": -6.0, "day": -6.0, "figure": -6.0,
    "no gap": -3.0, "opening": 2.5, "may close": -2.0, "capital": 2.0, "after ellipsis": 1.5, "russian": 6.0, "quoted": -9.0, "reported": -9.0,
}
#: What a unit without any letter or figure costs.
HOLLOW = 1e6

_END = re.compile(r"[.!?…।؟。！？｡]+")
_ABBR = regex.compile(r"[\p{L}\p{M}ª.\-]+$")
_NUM = regex.compile(r"\d+$")
_THAI = regex.compile(r"\p{Thai}")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_RUN = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_STOP = regex.compile(r"[。！？「“]")
_GAP = regex.compile(r"[^\S\n]+")
_QUOTES = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values()})) + "]")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_ERA = regex.compile(r"(?:\p{Thai}{1,3}\.)+")
_WEB = regex.compile(r"(?:www\.|://|@)\S*$")
_CLOSE = regex.compile(r"[।.؟!?]")


#: A run of characters belongs to the counted lexicon if its share of all places is at least 1 / SHARE, so that the lexicon has
#: at most SHARE entries of each length; it has up to GRAM characters and stands together COHESION times as often as its parts
#: would by chance.
SHARE, GRAM, COHESION = 20_000, 4, 20.0


def cohesive(counts: dict[str, int], total: int) -> frozenset[str]:
    """The runs of two characters or more that stand together more often than any two parts of them would by chance.

    ``total`` is the number of all places. A run that begins or ends with a word of the closed classes is one only where that is a single character to which the
    rest is bound, being no word of its own and standing beside it more often than not.
    """
    joint = lambda g, k: counts[g] * total / (counts.get(g[:k], total) * counts.get(g[k:], total))
    kept: set[str] = set()

    def free(closed: str, rest: str, g: str) -> bool:
        return WORDS.get(closed, "other") != "other" and (len(closed) > 1 or rest in WORDS or rest in kept or 2 * counts[g] < counts.get(rest, 0))

    for g in sorted((g for g in counts if len(g) > 1), key=lambda g: (len(g), g)):
        parts = [(g[:k], g[k:]) for k in range(1, len(g))]
        if all(joint(g, k) >= COHESION for k in range(1, len(g))) and not any(free(x, y, g) or free(y, x, g) for x, y in parts):
            kept.add(g)
    return frozenset(kept)


def lexicon(texts: DataFrame, column: str) -> frozenset[str]:
    """The words of spaceless scripts that the texts show, counted over all of them.

    Runs are counted per batch before the shuffle. What is sent to the driver are those with a share of 1 / SHARE of all
    places, of which there can't be more than SHARE of each length, whatever the number of texts.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            n: Counter = Counter()
            for t in pdf.iloc[:, 0]:
                for m in _RUN.finditer(t):
                    r = m.group()
                    for k in range(1, GRAM + 1):
                        n.update(r[i : i + k] for i in range(len(r) - k + 1))
            yield pd.DataFrame({"gram": list(n), "n": list(n.values())})

    some = texts.where(F.col(column).rlike(r"[\p{IsThai}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).select(F.col(column).cast("string"))
    counts = some.mapInPandas(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    total = counts.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 0  # one number
    often = counts.where(F.col("n") >= max(3, -(-total // SHARE)))
    return cohesive({r.gram: r.n for r in often.collect()}, total)


def words(run: str, known: Collection[str] = ()) -> tuple[str, ...]:
    """Cheapest path through the word lattice of ``run``: words of the closed classes cost 1, of the lexicon 1.1, other characters 1.2."""
    n = len(run)
    best = [0.0] + [1e9] * n
    back = [0] * (n + 1)
    for i, c in enumerate(run):
        here = best[i]
        if here + 1.2 < best[i + 1]:
            best[i + 1], back[i + 1] = here + 1.2, i
        for k in LENGTHS.get(c, ()):
            j = i + k
            if j <= n and here + 1.0 < best[j] and run[i:j] in WORDS:
                best[j], back[j] = here + 1.0, i
        if known:
            for j in range(i + 2, min(n, i + GRAM) + 1):
                if here + 1.1 < best[j] and run[i:j] in known:
                    best[j], back[j] = here + 1.1, i
    out = []
    j = n
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return tuple(reversed(out))


class Words:
    """The words of the spaceless runs of a line; a run's lattice is built when a gap beside it is looked at."""

    def __init__(self, line: str, lexicon: Collection[str] = ()):
        self.line, self.lexicon = line, lexicon
        self.known: dict[int, dict[int, str]] = {}
        self.runs = [m.span() for m in _RUN.finditer(line)]
        self.begins = [a for a, _ in self.runs]

    def _run(self, k: int) -> dict[int, str]:
        """Word by position."""
        if k not in self.known:
            a, b = self.runs[k]
            at = {}
            for w in words(self.line[a:b], self.lexicon):
                at[a] = w
                a += len(w)
            self.known[k] = at
        return self.known[k]

    def head(self, at: int) -> str:
        """The word that begins at ``at``."""
        k = bisect.bisect_right(self.begins, at) - 1
        return self._run(k).get(at, "") if k >= 0 and at < self.runs[k][1] else ""

    def tail(self, at: int) -> str:
        """The word that ends before ``at``."""
        k = bisect.bisect_left(self.begins, at) - 1
        return next(reversed(self._run(k).values())) if k >= 0 and at == self.runs[k][1] else ""

    def between(self, a: int, b: int) -> Iterator[tuple[int, str]]:
        """(position, word) of the words that begin in [a, b)."""
        for k in range(max(0, bisect.bisect_right(self.begins, a) - 1), bisect.bisect_left(self.begins, b)):
            yield from ((i, w) for i, w in self._run(k).items() if a <= i < b)

    def closing(self, a: int, b: int, prior: float) -> float:
        """What speaks for a sentence's end in the gap from ``a`` to ``b``, by the classes of the words beside it."""
        tail, head = self.tail(a), self.head(b)
        kind = WORDS.get(tail)
        before = a - len(tail)
        while kind == "unit" and before and self.line[before - 1].isspace():
            before -= 1
        if kind == "unit" and not (before and (self.line[before - 1].isnumeric() or self.line[before - 1] == "第")):
            kind = None  # a unit counts after a number only
        return prior + BEFORE.get(kind, 0.0) + AFTER.get(WORDS.get(head), 0.0) - 0.9

    def reported(self, at: int) -> bool:
        """Whether what follows a quotation reports it: a reporting word at the end of a clause before the next mark."""
        stop = _STOP.search(self.line, at)
        end = stop.start() if stop else len(self.line)
        return any(WORDS.get(w) == "report" and (i + len(w) == len(self.line) or self.line[i + len(w)] in "。！？，,:：") for i, w in self.between(at, end))


def _thai_gap(line: str, a: int, b: int, found: Words) -> float:
    """The score of the gap from ``a`` to ``b`` beside a Thai run."""
    if not a or b >= len(line):
        return -1.0
    left, right = line[a - 1], line[b]
    if left.isdigit() or right.isdigit() or left in ".,:;“‘«([" or right in "”’»)]:;,":
        return -1.0
    if left in "”»?!":
        gap = _GAP.search(line, b)
        return -1.0 if any(WORDS.get(w) == "report" for _, w in found.between(b, gap.start() if gap else len(line))) else 1.0
    if not _THAI.match(right):
        return 1.0 if right in "“«(‘" else -1.0
    if _ERA.match(line, b):
        return -1.0  # an abbreviation such as that of an era or a unit
    return found.closing(a, b, 1.0)  # in Thai a gap alone may close a sentence


def _cjk_gap(line: str, a: int, b: int, found: Words) -> float:
    """The score of white space within Chinese or Japanese: only the words beside it can speak for an end."""
    if not a or b >= len(line) or not _CJK.match(line[a - 1]):
        return -1.0
    return found.closing(a, b, 0.0) if _CJK.match(line[b]) else found.closing(a, b, 0.5) if line[b] in "“「『" else -1.0


class _Quotations:
    """Quotations and brackets of a line: how many reach over a place (those left open reach to the end), and openings by closings."""

    def __init__(self, line: str):
        stack: list[tuple[int, str]] = []
        spans = []
        for m in _QUOTES.finditer(line):
            i, c = m.start(), m.group()
            if stack and c == PAIRS.get(stack[-1][1]):
                s, _ = stack.pop()
                spans.append((s, i))
            elif c in PAIRS and c not in "[":
                if c == "“" and stack and stack[-1][1] == "„":
                    continue
                stack.append((i, c))
            elif c in "”»」』)）":
                for k in range(len(stack) - 1, -1, -1):
                    if PAIRS[stack[k][1]] == c:
                        spans.append((stack[k][0], i))
                        del stack[k:]
                        break
        spans += [(s, len(line)) for s, _ in stack]
        self.starts, self.ends = sorted(s for s, _ in spans), sorted(c for _, c in spans)
        self.opens = {c: s for s, c in sorted(spans, reverse=True)}

    def over(self, at: int) -> bool:
        """Whether any begins before ``at`` and doesn't end before it."""
        return bool(self.starts) and bisect.bisect_left(self.starts, at) > bisect.bisect_left(self.ends, at)


def split_line(line: str, lexicon: Collection[str] = ()) -> list[int]:
    """Ends of the sentence units within ``line`` (the end of the line is always one): the cheapest path of its lattice."""
    quotes = _Quotations(line)
    opens = quotes.opens
    found = Words(line, lexicon)
    n = len(line)
    nodes: dict[int, tuple[float, int]] = {}  # score, and the opening of a quotation that a report follows
    for m in _END.finditer(line):
        a, b = m.span()
        if line[a] == "." and b - a == 1 and a and _THAI.match(line[a - 1]):
            continue  # Thai has no full stop, only abbreviations
        e = b
        while e < n and (line[e] in CLOSERS or (line[e] == "“" and e in opens and line[opens[e]] == "„")):
            e += 1
        if e < n - 1 and line[e] in "   " and line[e + 1] == "»":
            e += 2
        f = e
        while f < n and line[f].isspace():
            f += 1
        if f >= n:
            continue
        score, opened = _scored(line, a, b, e, f, opens, found)
        if quotes.over(e):
            score += WEIGHTS["quoted"]
        if e not in nodes or score > nodes[e][0]:
            nodes[e] = score, opened
    if found.runs:
        for m in _GAP.finditer(line):
            a, b = m.span()
            if a in nodes or quotes.over(a):
                continue
            thai = _THAI.search(line, max(0, a - 12), a) or _THAI.match(line, b)
            nodes[a] = (_thai_gap if thai else _cjk_gap)(line, a, b, found), -1
    return _path(line, sorted((p, *x) for p, x in nodes.items()))


def _path(line: str, nodes: list[tuple[int, float, int]]) -> list[int]:
    """The cheapest path from the start of the line to its end through (place, score, opened quotation).

    An edge into a node costs minus its score, more where its unit is hollow or begins with the quotation that is reported
    behind it. The best node before a place is kept as a running minimum, so the search is linear in the nodes.
    """
    n = len(line)
    places = [0]
    cost = [0.0]
    back = [-1]
    low = [0]  # index of the cheapest node up to each one
    solid = 0  # nodes up to this index have a letter or figure between them and the current place
    last = -1  # place of the last letter or figure before the current place
    for place, score, opened in [*nodes, (n, 0.0, -1)]:
        k = place - 1
        while k >= places[-1] and not line[k].isalnum():
            k -= 1
        if k >= places[-1]:
            last = k
        while solid + 1 < len(places) and places[solid + 1] <= last:
            solid += 1
        full = places[solid] <= last
        best = low[solid] if full else low[-1]
        step = cost[best] - score + (0.0 if full else HOLLOW)
        if opened >= 0 and full:
            first = opened
            while first and line[first - 1].isspace():
                first -= 1
            k = bisect.bisect_left(places, first) - 1 if first else -1  # nodes from k + 1 on begin with the quotation
            inner = min(range(k + 1, solid + 1), key=cost.__getitem__, default=-1)
            outer = low[k] if k >= 0 else -1
            step, best = min((cost[x] - score + extra, x) for x, extra in ((inner, -WEIGHTS["reported"]), (outer, 0.0)) if x >= 0)
        places.append(place)
        cost.append(step)
        back.append(best)
        low.append(len(cost) - 1 if step < cost[low[-1]] else low[-1])
    ends = []
    k = len(places) - 1
    while k > 0:
        ends.append(places[k])
        k = back[k]
    return ends[::-1]


def _scored(line: str, a: int, b: int, e: int, f: int, opens: dict[int, int], found: Words) -> tuple[float, int]:
    """Score of the terminator [a, b) as an end at ``e``, and where the quotation opens that is reported behind it (-1: none).

    ``f`` is the next character that isn't white space.
    """
    w = WEIGHTS
    mark, nxt, gap, closed = line[a], line[f], f > e, e > b
    prev = line[a - 1] if a else ""
    head = f
    while head < len(line) and line[head] in OPENERS:
        head += 1
    first = line[head] if head < len(line) else ""
    word = _LETTERS.match(line, head)
    word = word.group() if word else ""
    dots = mark == "…" or mark == "." and b - a > 1
    opened = max((opens[c] for c in range(b - 1, e) if c in opens), default=-1) if closed else -1
    if _CJK.match(prev) or mark in "。！？｡" or _CJK.match(first):
        if mark == "." and not gap and b - a == 1:
            return (found.closing(a, f, 0.5) if _CJK.match(prev) and _CJK.match(first) else w["goes on"]), -1
        if dots:
            return (w["goes on"] if found.head(f) in CONTINUES else w["full"]), -1
        if closed and (nxt in "，,、。" or found.head(f) in ("と", "って", "的")):
            return w["goes on"], -1
        return w["full"], opened if opened >= 0 and _CJK.match(first) and found.reported(f) else -1
    if nxt in ",;:،؛—–-)]»”…" and not (nxt in "—–-" and not closed):
        return w["goes on"], -1
    caseless = bool(first) and not first.isupper() and not first.islower()
    if mark == "।" or mark in "!?؟…" and (caseless or not first) or mark == "." and caseless and not first.isdigit():
        token = _ABBR.search(line, max(0, a - ABBREVIATION), a)
        token = token.group().strip(".") if token else ""
        if mark == "." and (token.lower() in GOES_ON or not gap and prev.isdigit()):
            return w["abbreviation"], -1
        if mark == "…" or b - a > 1:
            return (w["goes on"] if word in CONTINUES else w["full"]), -1
        if opened >= 0 and line[e - 1] in "”»“":
            stop = _CLOSE.search(line, f)
            clause = line[f : stop.start() if stop else len(line)]
            return w["full"], opened if any(x in clause for x in REPORTS) else -1
        return w["full"], -1
    score = w["ellipsis"] if dots or b - a > 1 else w["stop"] if mark == "." else w["mark"]
    if first.islower():
        return score + w["small"] + (w["small name"] if len(word) > 1 and word[1].isupper() and gap else 0.0), -1
    if mark in "…" or b - a > 1:
        return score + (w["after ellipsis"] if first.isupper() or first.isdigit() or nxt in OPENERS else 0.0), -1
    if mark != "." or closed:
        return score, -1
    token = _ABBR.search(line, max(0, a - ABBREVIATION), a)
    token = token.group().strip("-") if token else ""
    low = token.lower().lstrip(".")
    part = low.rpartition(".")[2]
    if not token:
        num = _NUM.search(line, max(0, a - ABBREVIATION), a)
        if num and gap and len(num.group()) <= 2 and word.lower() in MONTHS:
            score += w["day"]
        if not gap:
            score += w["no gap"] + (w["opening"] if first.isupper() or (not num and nxt in OPENERS) else 0.0)
        return score, -1
    if first.isdigit() and (low in GOES_ON or low in MAY_END or not gap):
        return score + w["figure"], -1
    if not gap:
        plain = (first.isupper() or nxt in "“«¿¡(„") and len(low) > 1 and token[-1].islower() and "." not in low and not _WEB.search(line, max(0, a - ADDRESS), a)
        return score + w["no gap"] + (w["opening"] if plain else 0.0), -1
    if low in GOES_ON or part in GOES_ON and "." in low and low not in MAY_END:
        score += w["abbreviation"]
        if low in ("д", "п") and regex.search(r"т\.\s?" + low + "$", line[max(0, a - ABBREVIATION) : a]):
            score += w["russian"]  # "и т. д." and "и т. п." may close a sentence
        return score, -1
    if len(token) == 1 and token.isupper():
        return score + w["initial"], -1
    if low in MAY_END or part in MAY_END:
        score += w["may close"] + (w["capital"] if first.isupper() and not regex.match(r"\p{Lu}\.", line, pos=head) else 0.0)
    return score, -1


def sentences(text: str | None, line_ends: bool = True, lexicon: Collection[str] = ()) -> list[tuple[int, int]]:
    """[start, end) of every sentence unit of ``text``, without surrounding white space, in order.

    ``line_ends``: whether a line break always ends a unit; ``lexicon``: words of spaceless scripts beside the closed
    classes. Null, empty and blank texts have no units; a placeholder or the rest of a cut text is one unit.
    """
    if not text:
        return []
    out = []
    pos = 0
    for line in text.split("\n") if line_ends else [text]:
        last = 0
        if line.strip():
            body = line if line_ends else line.replace("\n", " ")
            for e in split_line(body, lexicon):
                s, t = last, e
                while s < t and body[s].isspace():
                    s += 1
                while t > s and body[t - 1].isspace():
                    t -= 1
                if t > s:
                    out.append((pos + s, pos + t))
                last = e
        pos += len(line) + 1
    return out


def sentence_units(items: DataFrame, id_col: str, text_col: str, line_ends: bool = True, lexicon: Collection[str] = ()) -> DataFrame:
    """(``id_col``, sent_no, sent_start, sent_end) of every row's sentence units; a narrow map, no shuffle.

    Rows with a null, empty or blank text give no units; equal rows give equal units; extra columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, k, s, e) for i, t in zip(pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1], strict=True) for k, (s, e) in enumerate(sentences(t if isinstance(t, str) else None, line_ends, lexicon))]
            yield pd.DataFrame(rows, columns=[id_col, "sent_no", "sent_start", "sent_end"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col), F.col(text_col).cast("string")).mapInPandas(run, f"`{id_col}` {kind}, sent_no int, sent_start bigint, sent_end bigint")


def found(sections: DataFrame, nodes: DataFrame, books: DataFrame) -> DataFrame:
    """Units of the sections of epub books and of all summaries.

    Exact repeats of a record are dropped before the text is looked at (by the record's id, which is unique but for
    repeats), so that the shuffle of that step carries each record once.
    """
    epub = books.where(F.lower("book_format") == "epub").select("book_id").distinct()
    s = sections.select("rec_id", "book_id", F.col("raw_text").alias("text")).join(epub, "book_id", "left_semi").select(F.lit("section").alias("item_kind"), "rec_id", "text")
    n = nodes.select(F.lit("summary").alias("item_kind"), "rec_id", F.col("summary_text").alias("text")).where("text is not null")
    items = checkpointed(s.unionByName(n).dropDuplicates(["item_kind", "rec_id"]))
    known = lexicon(items, "text")
    one = sentence_units(items.where("item_kind = 'section'"), "rec_id", "text", True, known).withColumn("item_kind", F.lit("section"))
    two = sentence_units(items.where("item_kind = 'summary'"), "rec_id", "text", False, known).withColumn("item_kind", F.lit("summary"))
    return one.unionByName(two).select("item_kind", "rec_id", "sent_start", "sent_end")
