import random
from pathlib import Path

import pytest

from quire.llm.tokens import TOKENIZERS, encode_documents, encoder, token_count
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_ids_as_the_library(reference):
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "中文", "กำ", "क्या", "1", "23", "-", "'s", "'ll", "<|endoftext|>", "😀", "‍", "\xa0", "\x85", "\x1c", "word", "x" * 300]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert encoder().encode(s) == reference(s), repr(s)


def test_fragments_are_certain_cuts():
    e = encoder()
    word = "ありがとうございますกรุณา" * 3
    raw = word.encode()
    assert b"".join(e.fragments(raw)) == raw and len(e.fragments(raw)) > 3


def test_rows_nulls_and_clashing_columns(frame, reference):
    texts = [None, "", " ", "Hello world", "Hello world", "z" * 20000]
    df = frame([(i, t, [9], "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>, n string")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert got[0] == [] and got[1] == [] and got[2] == reference(" ") and got[3] == got[4] == reference("Hello world") and got[5] == reference("z" * 20000)
    assert encode_documents(df.where("false")).collect() == []
    assert [r.n for r in df.select("doc_id", token_count(F.col("text")).alias("n")).orderBy("doc_id").collect()][:3] == [0, 0, len(reference(" "))]
