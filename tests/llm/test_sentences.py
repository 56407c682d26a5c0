import pytest

import time

from quire.llm import sentences as S
from quire.llm.sentences import cohesive, found, lexicon, sentence_units, sentences, words

CASES = [
    ("“The ford is lost! We should leave,” said the ferryman. (It is treated on p. 22.) Next one.", ["“The ford is lost! We should leave,” said the ferryman.", "(It is treated on p. 22.)", "Next one."]),
    ("Dr. A. B. Smith came at 5 p.m. The price rose by 1.38% in Oldport, approx. 4 times.", ["Dr. A. B. Smith came at 5 p.m.", "The price rose by 1.38% in Oldport, approx. 4 times."]),
    ("Der Rat, d. h. die Partei, kam am 7. Mai 1737. „Wer bezahlt das?“ fragte er. Ende.", ["Der Rat, d. h. die Partei, kam am 7. Mai 1737.", "„Wer bezahlt das?“ fragte er.", "Ende."]),
    ("L’an 1700. « Qui paiera ? » demandait le comité. M. Umden hésitait... puis partait.", ["L’an 1700.", "« Qui paiera ? » demandait le comité.", "M. Umden hésitait... puis partait."]),
    ("«¡No vendan!», gritó el Sr. López. ¿Quién pagó? Los sellos, etc. El fin.", ["«¡No vendan!», gritó el Sr. López.", "¿Quién pagó?", "Los sellos, etc.", "El fin."]),
    ("Печати и т. д. Старый писарь ждал, т. е. всё. «Кто заплатит?» — спросил он.", ["Печати и т. д.", "Старый писарь ждал, т. е. всё.", "«Кто заплатит?» — спросил он."]),
    ("商人说：“不能卖掉！”1833年，测量。“谁来支付？”议会问道。他犹豫了……后来还是走了。", ["商人说：“不能卖掉！”", "1833年，测量。", "“谁来支付？”议会问道。", "他犹豫了……后来还是走了。"]),
    ("彼は「もう遅い！」と言い、去った。「もうない。」修道院は隠した。", ["彼は「もう遅い！」と言い、去った。", "「もうない。」", "修道院は隠した。"]),
    ("डॉ. मठ ने पूछा। “कौन देगा?” मठ ने पूछा। बस।", ["डॉ. मठ ने पूछा।", "“कौन देगा?” मठ ने पूछा।", "बस।"]),
    ("«من سيدفع؟» سأل المجلس. أهمل التاجر 16.7 فدان (ص. 27). انتهى.", ["«من سيدفع؟» سأل المجلس.", "أهمل التاجر 16.7 فدان (ص. 27).", "انتهى."]),
    ("ในปี พ.ศ. 1842 ผู้แปลปกปิดจดหมาย คณะกรรมการวัดแผนที่ 26 ฉบับในหุบเขา สภาเมืองแปลหนังสือ", ["ในปี พ.ศ. 1842 ผู้แปลปกปิดจดหมาย", "คณะกรรมการวัดแผนที่ 26 ฉบับในหุบเขา", "สภาเมืองแปลหนังสือ"]),
    ("One leave.The other came; it stayed, too. It was the wi [cut]", ["One leave.", "The other came; it stayed, too.", "It was the wi [cut]"]),
    ("[summary unavailable]", ["[summary unavailable]"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


# Spaceless scripts: gaps that only the classes of the words beside them decide.
GAPS = [
    ("商人隐瞒了粮仓 我们测量地图 而委员会走了", ["商人隐瞒了粮仓", "我们测量地图 而委员会走了"]),
    ("你们走吧 商人隐瞒了 古老的粮仓", ["你们走吧", "商人隐瞒了 古老的粮仓"]),
    ("第一章 在港口", ["第一章 在港口"]),
    ("年份1833年 他测量了地图", ["年份1833年 他测量了地图"]),
    ("委员会走了吗.我们留下16.7亩", ["委员会走了吗.", "我们留下16.7亩"]),
    ("商人は港で手稿を隠した　評議会は地図を測りました 彼女は去った", ["商人は港で手稿を隠した", "評議会は地図を測りました", "彼女は去った"]),
    ("“谁来支付？”没有人知道。“谁来支付？”商人笑道。", ["“谁来支付？”", "没有人知道。", "“谁来支付？”商人笑道。"]),
    ("「もう遅い！」とても静かだ。", ["「もう遅い！」", "とても静かだ。"]),
    ("พ่อค้าไปแล้วครับ แต่เธออยู่ ผู้แปลวัดแผนที่ เขาวัดของ เธอ", ["พ่อค้าไปแล้วครับ", "แต่เธออยู่", "ผู้แปลวัดแผนที่", "เขาวัดของ เธอ"]),
    ("พ่อค้าบอกว่า ยุ้งฉางเก่าอยู่", ["พ่อค้าบอกว่า ยุ้งฉางเก่าอยู่"]),
]


@pytest.mark.parametrize("text,want", GAPS)
def test_gap_classes(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


def test_whole_runs_are_divided():
    run = "委员会测量了地图" * 400 + "吗"
    assert words(run)[-1] == "吗" and "".join(words(run)) == run and "道" not in words("没有人知道") and words("วัดแผนที่")[-1] == "แผนที่"


def test_line_breaks():
    text = "A Heading\nOne sentence. Another\n\n  \nLast"
    assert [text[a:b] for a, b in sentences(text)] == ["A Heading", "One sentence.", "Another", "Last"]
    assert len(sentences("One\nline.", False)) == 1


def test_units_are_trimmed_disjoint_and_cover_all_words():
    for text, _ in CASES:
        long = "\n".join([text] * 3)
        units = sentences(long)
        assert all(a < b and not long[a].isspace() and not long[b - 1].isspace() for a, b in units)
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:], strict=False))
        assert "".join("".join(long[a:b].split()) for a, b in units) == "".join(long.split())


def test_nothing_from_nothing():
    assert sentences(None) == sentences("") == sentences(" \n\t ") == []


def test_lattice_prefers_dictionary_words():
    assert words("ที่ท่า")[0] == "ที่" and "".join(words("未知の語")) == "未知の語"


def test_found_counts_repeats_once(frame):
    s = frame([(1, "e", "It went. So.", "x"), (1, "e", "It went. So.", "x"), (2, "p", "No. No.", "x"), (3, "e", None, "x")], "rec_id bigint, book_id string, raw_text string, sent_start string")
    n = frame([(9, "One. Two."), (10, None), (11, "  ")], "rec_id bigint, summary_text string")
    b = frame([("e", "epub"), ("p", "pdf")], "book_id string, book_format string")
    got = sorted((r.item_kind, r.rec_id, r.sent_start, r.sent_end) for r in found(s, n, b).collect())
    assert got == [("section", 1, 0, 8), ("section", 1, 9, 12), ("summary", 9, 0, 4), ("summary", 9, 5, 9)]
    assert sentence_units(s.where("false"), "rec_id", "raw_text").collect() == []


# Per script a text whose units need the words that the lattice finds.
BY_SCRIPT = {"zh": "商人隐瞒了粮仓 我们测量地图 而委员会走了", "ja": "商人は地図を測りました 彼女は去った", "th": "พ่อค้าบอกว่า ยุ้งฉางเก่าอยู่"}


@pytest.mark.parametrize("script", BY_SCRIPT)
def test_units_depend_on_the_word_lattice(script, monkeypatch):
    text = BY_SCRIPT[script]
    with_words = sentences(text)
    monkeypatch.setattr(S, "words", lambda run, known=(): (run,))
    assert sentences(text) != with_words


def test_units_depend_on_the_counted_lexicon():
    """街道 and 知道 end in a character that alone reports speech; counted often enough they are words of the lattice."""
    text = "“谁来？”他们熟悉门道。后来走了。"
    assert words("门道")[-1] == "道"
    counts = {"门": 40, "道": 60, "门道": 38, "他": 5000, "们": 5000}
    known = cohesive(counts, 10_000)
    assert "门道" in known and words("门道", known) == ("门道",)
    assert len(sentences(text, lexicon=known)) == len(sentences(text)) + 1
    # what is free to stand alone is no part of a longer word
    assert "人道" not in cohesive({"人": 400, "道": 400, "人道": 40}, 10**6)


def test_lexicon_is_counted_over_all_texts(frame):
    df = frame([("委员会测量地图。" * 9,), ("图书馆测量，测量！",), (None,), ("no such script",), ("",), ("".join(chr(0x5000 + i) for i in range(600)),)], "t string")
    known = lexicon(df, "t")
    assert "测量" in known and not any("，" in w for w in known)
    assert lexicon(df.where("false"), "t") == frozenset()


def test_cheapest_path_spares_reported_quotations():
    """The end behind a quotation that a report follows is not taken from its own opening, but is from further back."""
    assert [x for x in sentences("He left. „Wer zahlt das?“ fragte er. Ende.")] == [(0, 8), (9, 36), (37, 42)]
    nodes = [(4, 3.0, -1), (8, 1.0, 4), (12, 1.0, -1)]
    assert S._path("aaaabbbbccccdddd", nodes) == [4, 12, 16]
    assert S._path("aaaabbbbccccdddd", [(4, 1.0, -1), (8, 3.0, 4), (12, 1.0, -1)]) == [8, 12, 16]
    assert S._path("aaaa----cccc----", [(4, 1.0, -1), (8, 1.0, -1), (12, 1.0, -1)]) in ([4, 16], [8, 16])


def test_long_lines_take_linear_time():
    line = "It went (so he said). “No!” he cried. " * 4000
    t = time.time()
    n = len(sentences(line))
    assert n == 8000 and time.time() - t < 10
