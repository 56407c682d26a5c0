"""Text helpers shared by the operators: contents, scripts and languages."""

from __future__ import annotations

import functools
import re
from collections import Counter

import regex

from quire.llm.dictionaries import FUNCTION_WORDS

# Texts that only stand in for a missing one.
STAND_INS = set("null none nil nan n/a na n.a. tbd tba todo tk undefined missing empty blank unavailable pending placeholder untitled".split())
# Words of which a bracketed stand-in consists.
STAND_WORDS = set(
    "no not none nothing text bracket summary content result response answer output value data available unavailable missing empty written came back here yet given provided "
    "returned generated produced pending omitted blank placeholder editorial for this the was is none n/a null insert kein keine text nicht vorhanden leer aucun texte vide sin texto vacío".split()
)
_WRAP = regex.compile(r'^\s*\{\s*"[\w ]+"\s*:\s*"(.*)"\s*\}\s*$', regex.S)
_CONTENT = regex.compile(r"[\p{L}\p{N}]")
_INVISIBLE = regex.compile(r"[\p{C}\p{Z}\s]+")


def hollow(text: str | None) -> bool:
    """Whether a text has no content of its own: missing, blank, marks only, or a mere stand-in."""
    if text is None:
        return True
    m = _WRAP.match(text)
    if m:
        text = m.group(1)
    if not _CONTENT.search(text):
        return True
    t = _INVISIBLE.sub(" ", text).strip().lower()
    if t.strip(".:;,-–—_*\"'()[]{}<>") in STAND_INS or t in STAND_INS:
        return True
    if t[0] in "[(<{" and t[-1] in "])>}":
        ws = regex.findall(r"[\p{L}/]+", t)
        return bool(ws) and all(w in STAND_WORDS or w in STAND_INS for w in ws)
    return False


_WORDS_OF: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _WORDS_OF.setdefault(_w, []).append(_l)
SCRIPTS = [("ru", regex.compile(r"\p{Cyrillic}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("th", regex.compile(r"\p{Thai}")), ("ko", regex.compile(r"\p{Hangul}")), ("kana", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("han", regex.compile(r"\p{Han}")), ("latin", regex.compile(r"\p{Latin}"))]
#: Letters of a spaceless script count for more than one, as they carry more text.
WEIGHT = {"han": 2.5, "kana": 2.0, "th": 1.2}
_LETTERS = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=1 << 16)
def _script(c: str) -> str | None:
    return next((k for k, p in SCRIPTS if p.match(c)), None)


def language(text: str | None) -> str | None:
    """The main language of a text by script and dictionary; None where that can't be told (in Latin letters by two words at least)."""
    if not text:
        return None
    counts = dict.fromkeys((k for k, _ in SCRIPTS), 0.0)
    for c, n in Counter(text).items():
        k = _script(c)
        if k:
            counts[k] += n * WEIGHT.get(k, 1.0)
    if counts["kana"] > 0.15 * (counts["kana"] + counts["han"]):
        counts["ja"] = counts.pop("kana") + counts.pop("han")
    else:
        counts["zh"] = counts.pop("han") + counts.pop("kana")
    top = max(counts, key=counts.get)
    if counts[top] < 3:
        return None
    if top != "latin":
        return top
    hits: dict[str, float] = {}
    seen: dict[str, set[str]] = {}
    for w, n in Counter(_LETTERS.findall(text.lower())).items():
        langs = _WORDS_OF.get(w)
        if langs:
            for x in langs:
                hits[x] = hits.get(x, 0) + n / len(langs)
                seen.setdefault(x, set()).add(w)
    if not hits:
        return None
    order = sorted(hits.items(), key=lambda x: -x[1])
    if order[0][1] < 1 or len(seen[order[0][0]]) < 2 or (len(order) > 1 and order[0][1] < 1.25 * order[1][1]):
        return None
    return order[0][0]
