from pathlib import Path

import pytest

from quire.llm.mixture import mixture, shares
from quire.llm.tokens import TOKENIZERS

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no tokenizer files here")
T = "source string, target_share double, max_repeats int"


def docs(frame):
    rows = [(i, "word " * (5 + i % 40), "big") for i in range(600)] + [(1000 + i, f"line {i} of text here", "small") for i in range(30)] + [(2000 + i, "the same text", "same") for i in range(50)] + [(3000, None, "big"), (3001, "", "small"), (3002, "orphan", None), (3003, "not wanted", "other")]
    return frame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, source string, n bigint, copies string")


def test_shares_caps_and_determinism(frame):
    d, t = docs(frame), frame([("big", 0.6, 1), ("small", 0.2, 3), ("same", 0.1, 2), ("absent", 0.1, 4), (None, 0.0, 1)], T)
    s = {r.source: r for r in shares(d, t).collect()}
    assert s["absent"].tokens == 0 and s["absent"].actual_share == 0
    for k, want in (("big", 0.6), ("small", 0.2), ("same", 0.1)):
        assert abs(s[k].actual_share - want / 0.9) < 0.02, s
        assert s[k].most_copies <= {"big": 1, "small": 3, "same": 2}[k]
    m = mixture(d, t).collect()
    assert len({r.doc_id for r in m}) == len(m) and not {3000, 3001, 3002, 3003} & {r.doc_id for r in m}
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixture(d.repartition(7), t).collect()))


def test_total_beyond_the_caps(frame):
    t = frame([("big", 0.5, 1), ("small", 0.5, 2)], T)
    s = {r.source: r for r in shares(docs(frame), t, total=10**9).collect()}
    assert s["small"].most_copies == 2 and s["big"].most_copies == 1


def test_empty(frame):
    d, t = docs(frame), frame([("big", 1.0, 1)], T)
    assert mixture(d.where("false"), t).collect() == [] and mixture(d, t.where("false")).collect() == []
