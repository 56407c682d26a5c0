import pytest

from quire.llm import scans

BL = "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string, gap string"
BODY = "The council restored the har-\nbour of Orlen. The well-\nknown ledger was closed and the harbour\nstood low."


def book(frame):
    rows, rec = [], 0
    for p in range(1, 31):
        rec += 10
        rows.append((rec, "b", p, 0, f"THE QUIET LEDGER   {p}", "body" if p in (4, 9) else "header", "x"))
        rows.append((rec + 1, "b", p, 1, BODY, "body", "x"))
        rows.append((rec + 2, "b", p, 2, "The well-known harbour of Orlen was restored by the council." if p != 7 else "The vvell-known barbour of Or1en was resto-", "body", "x"))
    rows += [(1, "b", 8, 0, "red by the council again.", "body", "x")]
    rows += [(rows[1][0], *rows[1][1:]), (900, "b", 12, 5, None, "body", "x"), (901, "b", 12, 6, " ", "body", "x"), (902, "b", 12, 7, "1842", "body", "x"), (903, "b", 12, 8, "* * *", "body", "x"), (904, "e", 1, 0, "Or1en", "body", "x")]
    return frame(rows, BL), frame([("b", "pdf", "The Quiet Ledger", 1), ("e", "epub", None, 1)], "book_id string, book_format string, title string, first int")


def test_cases(frame):
    blocks, books = book(frame)
    got = sorted((r.rec_id, r.noise) for r in scans.cases(blocks.where("rec_id <> 1 or page_no <> 8"), books).collect())
    assert {r for r, k in got if k == "furniture"} == {40, 90}
    assert (72, "glyph") in got and (72, "break") in got and [r for r, k in got if k == "glyph"] == [72]
    assert {r for r, k in got if k == "break"} == {10 * p + 1 for p in range(1, 31)} | {72}
    assert not {900, 901, 902, 903, 904} & {r for r, _ in got}


def test_paragraphs_are_whole(frame):
    blocks, books = book(frame)
    got = {(r.page_no, r.block_idx): r.text for r in scans.paragraphs(blocks.where("page_no <> 8 or rec_id = 1"), books).collect()}
    assert got[(1, 1)] == "The council restored the harbour of Orlen. The well-known ledger was closed and the harbour stood low."
    assert got[(7, 2)] == "The well-known harbour of Orlen was restored by the council again."
    assert not any(t.startswith("THE QUIET") for t in got.values()) and (8, 0) not in got


def test_variants_undo_confusions():
    assert "harbour" in scans.variants("barbour") and "modern" in scans.variants("rnodern") and "still" in scans.variants("stil1") and "Vallisund" in scans.variants("Va1lisund")


def test_nothing(frame):
    blocks, books = book(frame)
    assert scans.cases(blocks.where("false"), books).collect() == []


SEAMS = [
    ("The price rose by 6.58% in", "Dunvarra, approx. 9 times the usual.", True, False, False, True),
    ("Der Rat kam am", "14. Mai 1737 zur Brücke.", True, False, False, True),
    ("Der Rat verließ die", "Brücke am Abend.", True, False, False, True),
    ("The council counted about", "1,842 footnotes in the ledger.", True, False, False, True),
    ("The ferryman turned and said,", "“The ford is lost!”", False, False, False, True),
    ("商人在港口隐瞒了古老的", "粮仓和地图。", True, False, False, True),
    ("أهمل التاجر في", "الوادي القديم.", True, False, False, True),
    ("The genealogy measured 21.6 cm, i.e.", "less than the other.", True, False, False, True),
    ("They were led by Dr.", "Smith of Orlen.", True, False, False, True),
    ("and then the Vall-", "ISUND council", True, True, False, True),
    ("The council went home.", "Dunvarra rose.", True, False, False, False),
    ("The ferryman said no.", "Dunvarra rose.", True, False, False, False),
    ("The price rose by 6.58% in", "Dunvarra", True, False, True, False),
    ("The price rose by 6.58% in", "* * *", True, False, False, False),
    ("The price rose by 6.58% in", "1842", True, False, False, False),
    ("The list has these entries", "2. Ledgers", True, False, False, False),
    ("The Quiet Harbour", "Dunvarra rose by 4%.", False, False, False, False),
    ("The ledgers are these:", "Dunvarra rose.", True, False, False, False),
    ("ในปีนั้นผู้แปลวัดแผนที่", "เขาวัดบัญชี", True, False, False, False),
    ("ในปีนั้นผู้แปลบอกว่า", "เขาวัดบัญชี", True, False, False, True),
    ("The council went home.", "eReaders rose.", True, False, False, False),
]


@pytest.mark.parametrize("tail,head,long,cut,apart,want", SEAMS)
def test_goes_on(tail, head, long, cut, apart, want):
    assert scans.goes_on(tail, head, long, cut, apart) is want


def test_paragraphs_go_on_in_capitals_and_caseless_scripts(frame):
    long = "The council of Orlen restored the whole harbour before winter, while the price of salt rose by 6.58% in"
    zh = "委员会" + "在港口忽略了年度报告而商人隐瞒了古老的粮仓，" * 5 + "而叙述者翻译了"
    more = "The council sat there.\nIt was late."
    mid = "Dunvarra throughout the long winter and after\nthe vote of the parliament, until the"
    rows = [(1, 1, 0, more), (2, 1, 1, long), (3, 2, 0, mid), (4, 3, 0, "Vallisund blockade. It ended."), (5, 3, 1, more), (6, 5, 0, more), (7, 5, 1, long), (9, 6, 1, "Dunvarra lay still. It ended."), (10, 6, 2, more), (11, 8, 0, more), (12, 8, 1, zh), (13, 9, 0, "年度报告。"), (14, 9, 1, more), (16, 11, 0, more), (17, 11, 1, "Das Komitee verzeichnete am Abend noch die\nNord-"), (18, 12, 0, "Süd-Straße am Ufer."), (19, 12, 1, more)]
    rows = [(r, "b", p, k, t, "body", "x") for r, p, k, t in rows] + [(8, "b", 6, 0, "Part Two", "title", "x"), (15, "b", 3, 7, "A map", "caption", "x")]
    books = frame([("b", "pdf", "The Quiet Ledger", 1)], "book_id string, book_format string, title string, first int")
    got = {(r.page_no, r.block_idx): r.text for r in scans.paragraphs(frame(rows, BL), books).collect()}
    rest = more.replace("\n", " ")
    want = {(1, 1): f"{long} {mid} Vallisund blockade. It ended.".replace("\n", " "), (5, 1): long, (6, 1): "Dunvarra lay still. It ended.", (8, 1): zh + "年度报告。", (11, 1): "Das Komitee verzeichnete am Abend noch die Nord-Süd-Straße am Ufer."}
    assert got == want | {k: rest for k in ((1, 0), (3, 1), (5, 0), (6, 2), (8, 0), (9, 1), (11, 0), (12, 1))}


def test_misread_by_both_joins(frame):
    forms = scans.block_forms(frame([(1, "one vvell two"), (2, "vvell bar-\nbour bar"), (3, "clean words"), (4, "")], "rec_id bigint, text string"))
    bad = frame([("vvell",), ("barbour",)], "word string")
    ways = [sorted((r.rec_id, list(r.words)) for r in scans.with_misread(forms, bad, most).collect()) for most in (100, 0)]
    assert ways[0] == ways[1] == [(1, ["vvell"]), (2, ["barbour", "vvell"])]


def test_long_words_count(frame):
    long = "Donaudampfschifffahrtselektrizitätenhaupt"  # 41 characters
    assert len(long) == 41
    counts = {r.word: r.n for r in scans.word_counts(scans.block_forms(frame([(1, f"{long} and {long}")], "rec_id bigint, text string"))).collect()}
    assert counts[long] == 2 and scans.variants("x" * 100_000) == [] and "Donaudampfschifffahrtselektrizitätenhaupt" in scans.variants(long.replace("h", "b", 1))


def _typeset(rng, paragraphs, wide=46, lines=9):
    """Pages of blocks as a scanner sees them: lines of a width, divided words, misread letters, headers and page numbers."""
    pages, page, room, no = [], [], lines, 1
    for text in paragraphs:
        words, rows, row = text.split(), [], ""
        while words:
            w = words.pop(0)
            if len(row) + len(w) + 1 <= wide:
                row = f"{row} {w}".strip()
            elif len(w) > 7 and w.isalpha() and len(row) + 5 <= wide and rng.random() < 0.6:
                rows.append(f"{row} {w[:4]}-")
                row = w[4:]
            else:
                rows.append(row)
                row = w
        rows.append(row)
        while rows:
            part, rows = rows[:room], rows[room:]
            page.append("\n".join(part))
            room -= len(part)
            if room <= 0 or rows:
                pages.append((no, page))
                page, room, no = [], lines, no + 1
    pages.append((no, page))
    out, rec = [], 0
    for no, page in pages:
        for k, (text, kind) in enumerate([(f"A BOOK OF FERRIES   {no}", "header" if no % 5 else "body"), *[(t, "body") for t in page], (f"{no}", "folio" if no % 4 else "body")]):
            rec += 1
            if kind == "body" and rng.random() < 0.06:
                text = text.replace("harbour", "barbour", 1).replace("modern", "rnodern", 1)
            out.append((rec, "b", no, k, text, kind))
    return out


def test_paragraphs_of_typeset_pages(frame):
    """What share of known paragraphs comes back exactly from noisy pages."""
    import random

    rng = random.Random(3)
    nouns, verbs = "harbour ferry captain lantern warehouse merchant passenger timetable quarrel modern bridge".split(), "carried repaired described forgot measured remembered".split()
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} beside the {rng.choice(nouns)} before the {rng.choice(nouns)} of the morning."
    want = [" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(150)]
    rows = _typeset(rng, want)
    blocks = frame(rows, "rec_id bigint, book_id string, page_no int, block_idx int, text string, classification string")
    books = frame([("b", "pdf", "A Book of Ferries")], "book_id string, book_format string, title string")
    got = [r.text for r in sorted(scans.paragraphs(blocks, books).collect(), key=lambda r: (r.page_no, r.block_idx))]
    whole = len(set(want) & set(got)) / len(set(want))
    print(f"paragraphs restored exactly: {whole:.3f} of {len(want)}, {len(got)} rows")
    assert whole > 0.9
    assert not any("FERRIES" in t for t in got)
