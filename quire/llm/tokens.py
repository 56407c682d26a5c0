"""Problem 7: token ids of every text by a public byte-level tokenizer.

A pair of bytes that is adjacent inside no vocabulary entry can never be bridged by a merge, so a certain cut
lies between the two. A text is first taken apart by the tokenizer's own pattern, then every part at its
certain cuts; the fragments are encoded on their own and the ids put together again. Fragments repeat far more
often than texts, so each distinct one is encoded once per worker.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pre-tokenization pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct parts kept per worker; beyond it the memory is emptied (ids stay the same).
MEMO = 200_000


class Encoder:
    """byte_bpe_50k by forced-boundary splitting."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        inside = np.zeros((256, 256), bool)
        for token in self.ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        self.certain = ~inside
        import tiktoken

        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def fragments(self, part: bytes) -> list[bytes]:
        """``part`` divided at its certain cuts."""
        b = np.frombuffer(part, np.uint8)
        cuts = [0, *(np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1).tolist(), len(part)]
        return [part[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def part(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        if one is not None:
            return [one]
        out: list[int] = []
        for f in self.fragments(raw):
            one = self.ranks.get(f)
            out += [one] if one is not None else self.core.encode_single_piece(f)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; of an empty text none."""
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for p in self.find(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.part(p)
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS) -> Encoder:
    return Encoder(f"{folder}/byte_bpe_50k.tiktoken")


def encode_documents(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>) of every row.

    A null text and an empty one have an empty list; white space alone is text and has ids. Rows are neither
    dropped nor merged; other columns are ignored whatever they are called. A narrow map without a shuffle, so it
    scales with the number of input splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat += enc.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_count(text: Column, folder: str = TOKENIZERS) -> Column:
    """Number of byte_bpe_50k tokens of a text; null and empty texts have 0."""

    @pandas_udf("int")
    def count(s):
        enc = encoder(folder)
        return s.map(lambda t: len(enc.encode(t)) if t else 0).astype("int32")

    return count(text)
