"""EPUB files as blocks: binaryFile, unzipped and parsed in batches on the workers.

A file that can't be read gives one row with its reason, never an exception: drm (encrypted), corrupt (no container, no
spine or no zip). A spine item that is missing from the manifest has no page; one that can't be parsed has an empty page.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.blocks import CAPTION

# Elements that make a block, and those whose text is no text.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "div", "figcaption"}
SILENT = {"script", "style", "head", "template"}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "source", "wbr"}
_CAPTION = re.compile(CAPTION)
SCHEMA = "path string, ok boolean, reason string, title string, author string, page_no int, block_idx int, spine_item_id string, tag string, text string, classification string"


class Blocks(HTMLParser):
    """Outermost-first walk: text belongs to the innermost block element; a div counts where no other block holds the text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.silent = self.code = 0
        self.out: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in VOID:
            if tag == "br" and self.stack:
                self.stack[-1]["text"].append("\n")
            return
        cls = (dict(attrs).get("class") or "").split()
        if (tag == "math" or "math" in cls) and self.stack:
            self.stack[-1]["protected"] = True  # a formula protects the block it stands in, code only blocks within it
        self.code += tag == "code"
        if tag in BLOCKS and self.stack and self.stack[-1]["tag"] == "p":
            self._close("p")  # a block ends an open paragraph
        if tag in BLOCKS:
            inside = tag == "pre" or self.code > 0 or any(x["tag"] == "pre" for x in self.stack)
            b = {"tag": tag, "text": [], "note": any("footnote" in c for c in cls), "protected": inside or "math" in cls}
            self.stack.append(b)
            self.out.append(b)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1
        elif tag in BLOCKS:
            self._close(tag)

    def handle_endtag(self, tag):
        self.code -= tag == "code" and self.code > 0
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self._close(tag)

    def _close(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not self.silent and self.stack:
            self.stack[-1]["text"].append(data)


def html_blocks(source: str) -> list[tuple[str, str, str]]:
    """(tag, text, class) of the blocks of a page in document order; empty ones are dropped."""
    p = Blocks()
    p.feed(source)
    p.close()
    out = []
    for b in p.out:
        text = " ".join("".join(b["text"]).split())
        if not text:
            continue
        caption = b["tag"] == "figcaption" or len(text) < 200 and bool(_CAPTION.match(text))
        kind = "protected" if b["protected"] else "body" if b["tag"][0] == "h" and b["tag"][1:].isdigit() else "caption" if caption else "footnote" if b["note"] else "body"
        out.append((b["tag"], text, kind))
    return out


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def read_book(path: str, data: bytes) -> list[tuple]:
    """Rows of one file in the order of its spine."""
    fail = lambda reason: [(path, False, reason, None, None, None, None, None, None, None, None)]
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names:
            return fail("drm")
        root = next(e for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _name(e) == "rootfile").get("full-path")
        opf = ElementTree.fromstring(z.read(root))
        base = posixpath.dirname(root)
        first = lambda n: next(((e.text or "").strip() or None for e in opf.iter() if _name(e) == n), None)
        manifest = {e.get("id"): posixpath.normpath(posixpath.join(base, e.get("href") or "")).lstrip("/") for e in opf.iter() if _name(e) == "item"}
        spine = [e.get("idref") for e in opf.iter() if _name(e) == "itemref"]
    except Exception:  # noqa: BLE001
        return fail("corrupt")
    if not spine:
        return fail("corrupt")
    title, author = first("title"), first("creator")
    rows, page = [], 0
    for item in spine:
        if item not in manifest:
            continue
        page += 1
        try:
            found = html_blocks(z.read(manifest[item]).decode("utf-8", "replace"))
        except Exception:  # noqa: BLE001
            found = []
        if not found:
            rows.append((path, True, None, title, author, page, None, item, None, None, None))
        rows += [(path, True, None, title, author, page, k, item, tag, text, kind) for k, (tag, text, kind) in enumerate(found)]
    return rows


def parse(files: DataFrame) -> DataFrame:
    """Blocks of (path, content) rows; a page without blocks has one row without text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(read_book(path, bytes(content) if content is not None else b""), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all .epub files under ``path``."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path))


def routed(files: DataFrame) -> DataFrame:
    """(path, kind): epub or pdf by the file's name, else unsupported-format."""
    p = F.lower("path")
    return files.select("path", F.when(p.endswith(".epub"), "epub").when(p.endswith(".pdf"), "pdf").otherwise("unsupported-format").alias("kind"))


PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>{body}</body></html>'


def rewrite(data: bytes, brackets: dict[str, str]) -> tuple[bytes | None, int]:
    """The file with the given spine items replaced by their brackets, and how many were; None if it can't be read."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        root = next(e for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _name(e) == "rootfile").get("full-path")
        base = posixpath.dirname(root)
        hrefs = {e.get("id"): posixpath.normpath(posixpath.join(base, e.get("href") or "")).lstrip("/") for e in ElementTree.fromstring(z.read(root)).iter() if _name(e) == "item"}
    except Exception:  # noqa: BLE001
        return None, 0
    new = {hrefs[i]: t for i, t in brackets.items() if i in hrefs}
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            if info.filename in new:
                parts = [p.strip() for p in (new[info.filename] or "").split("\n\n") if p.strip()] or ["[omitted]"]
                w.writestr(info.filename, PAGE.format(title="", body="".join(f"<p>{html.escape(p)}</p>" for p in parts)))
                n += 1
            else:
                w.writestr(info, z.read(info.filename), zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue(), n


def rewritten(files: DataFrame, brackets: DataFrame) -> DataFrame:
    """(path, content, replaced): files with the spine items of (path, spine_item_id, bracket) replaced by their texts.

    The items of one file are gathered with it, as many as its spine has; a file without any is written as it is.
    """
    b = brackets.groupBy("path").agg(F.collect_list(F.struct("spine_item_id", F.coalesce("bracket", F.lit("")).alias("bracket"))).alias("b"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content, items in zip(pdf["path"], pdf["content"], pdf["b"], strict=True):
                data, n = rewrite(bytes(content) if content is not None else b"", {x["spine_item_id"]: x["bracket"] for x in items} if items is not None else {})
                rows.append((path, data, n))
            yield pd.DataFrame(rows, columns=["path", "content", "replaced"])

    return files.select("path", "content").join(b, "path", "left").mapInPandas(run, "path string, content binary, replaced int")
