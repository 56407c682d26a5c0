from quire.operators import events as E
from quire.operators import model as M
from quire.plans.logs import _epub
from quire.sources import epub, store
from quire.session import checkpointed


def test_epub_pages_and_failures(spark, frame, tmp_path):
    (tmp_path / "one.epub").write_bytes(_epub())
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    got = epub.read_epubs(spark, str(tmp_path)).collect()
    bad = [r for r in got if not r.ok]
    assert [r.reason for r in bad] == ["corrupt"]
    pages = {(r.page_no, r.spine_item_id) for r in got if r.ok}
    assert pages == {(1, "a"), (2, "b"), (3, "c")}
    assert [(r.tag, r.text, r.classification) for r in sorted((x for x in got if x.page_no == 2), key=lambda x: x.block_idx)] == [("p", "Figure 3. A map", "caption"), ("p", "unclosed", "body"), ("pre", "code here", "protected"), ("p", "1 note", "footnote")]
    assert epub.routed(frame([("a.EPUB",), ("b.pdf",), ("c.txt",)], "path string")).collect()[2].kind == "unsupported-format"


def test_store(spark, frame, tmp_path):
    base = frame([("r", "a", 1, "x"), ("r", "b", 1, "y")], "run_id string, id string, t int, v string")
    ch = frame([("r", "a", 1, "z"), ("r", "c", 0, "w")], "run_id string, id string, t int, v string")
    assert sorted((r.id, r.v) for r in store.upserted(base, ch, ["run_id", "id"], "t").collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    assert sorted((r.id, r.v) for r in store.patched(base, frame([("r", "b", None)], "run_id string, id string, v string"), ["run_id", "id"]).collect()) == [("a", "x"), ("b", "y")]
    assert [r.v for r in store.get(base, id="b").collect()] == ["y"] and [r.id for r in store.listed(base, ["id"], run_id="r").collect()] == ["a", "b"] and store.listed(base, run_id=None).collect() == []
    assert sorted(map(tuple, store.removed(base, frame([("r",), ("q",), ("r",)], "run_id string")).collect())) == [("q", 0), ("r", 2)]
    assert store.without_run(base, frame([("r",)], "run_id string")).collect() == []
    log = str(tmp_path / "log")
    for k in range(2):
        store.append_log(spark, log, frame([(k * 10 + i, f"e{k}{i}") for i in range(7)], "ts int, v string"))
    assert [r.id for r in spark.read.parquet(log).orderBy("id").collect()] == list(range(1, 15))


def test_provider_failure_is_a_row(frame):
    class Broken:
        def complete(self, batch):
            raise RuntimeError("no line")

    req = frame([("q", "summary", "a b c", 2), ("e", "summary", None, 2)], "request_id string, kind string, text string, most int")
    assert {r.error for r in M.complete(req, Broken).collect()} == {"RuntimeError: no line"}
    assert {r.request_id: r.reply for r in M.complete(req).collect()} == {"q": '{"summary": "a b"}', "e": '{"summary": ""}'}


def test_admission_passes_over_what_does_not_fit(frame):
    df = frame([("k", i, s) for i, s in enumerate([7, 7, 3, 1])] + [("n", 0, None)], "k string, i int, s int")
    assert [(r.i, r.admitted) for r in E.admitted(df, "k", ["i"], "s", 10).orderBy("i").collect()] == [(0, True), (1, False), (2, True), (3, False)]


def test_checkpoint_keeps_rows(frame):
    assert checkpointed(frame([(1,)], "a int")).count() == 1


def test_html_classes():
    long = "Figure 3. " + "x" * 200
    html = f"<p>Use <code>x</code> here.</p><code><p>inner</p></code><p>See <math><mi>x</mi></math></p><p class='math'>y</p><p>{long}</p><p>Fig. 2 a map</p><p>figures are</p><pre><p>z</p></pre>"
    assert [k for _, _, k in epub.html_blocks(html)] == ["body", "protected", "protected", "protected", "body", "caption", "body", "protected"]
