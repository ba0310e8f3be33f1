"""Office documents as blocks of text: paragraphs of body, headers and footers, comments, deletions, links."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = re.compile(r"^word/(document|header\d*|footer\d*|comments)\.xml$")
_KINDS = {"document": "body", "header": "header", "footer": "footer", "comments": "comment"}
_RELATION = re.compile(r"<Relationship\b[^>]*>")
BLOCK_SCHEMA = "path string, doc_id string, kind string, block_order int, text string, warning string"


def _text(paragraph: ElementTree.Element, tag: str) -> str:
    out = []
    for x in paragraph.iter():
        if x.tag == _W + tag:
            out.append(x.text or "")
        elif x.tag in (_W + "tab", _W + "br") and tag == "t":
            out.append("\t" if x.tag.endswith("tab") else "\n")
    return "".join(out)


def _outermost(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs that lie in no other one; a text box is folded into the paragraph around it."""
    for child in node:
        if child.tag == _W + "p":
            yield child
        else:
            yield from _outermost(child)


def blocks_of(raw: bytes) -> Iterator[tuple[str, str]]:
    """``(kind, text)`` of a document's non-empty blocks; a file that is no archive is one block of plain text."""
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        yield "body", raw.decode("utf-8", "replace")
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for name in sorted(archive.namelist(), key=lambda n: (n != "word/document.xml", n)):
            if m := _PARTS.match(name):
                kind = _KINDS[re.sub(r"\d", "", m[1])]
                root = ElementTree.fromstring(archive.read(name))
                for p in _outermost(root):
                    for what, tag in ((kind, "t"), ("tracked-deletion", "delText")):
                        if text := _text(p, tag).strip("\n"):
                            yield what, text
            elif name.startswith("word/_rels/") and name.endswith(".rels"):
                for tag in _RELATION.findall(archive.read(name).decode("utf-8", "replace")):
                    target = re.search(r'\bTarget="([^"]*)"', tag)
                    if target and 'TargetMode="External"' in tag and tag.find("/hyperlink") >= 0:
                        yield "hyperlink", unescape(target[1])


def read_blocks(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Blocks of all files of a folder; doc_id is the SHA-256 of the content; a broken file gives one row with a warning."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, doc_id, raw in zip(b["path"], b["doc_id"], b["content"], strict=True):
                try:
                    rows = [(where, doc_id, k, i, t, None) for i, (k, t) in enumerate(blocks_of(raw))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows = [(where, doc_id, "unsupported", 0, "", str(e))]
                yield pd.DataFrame(rows, columns=["path", "doc_id", "kind", "block_order", "text", "warning"])

    return files.select("path", F.sha2("content", 256).alias("doc_id"), "content").mapInPandas(run, BLOCK_SCHEMA)
