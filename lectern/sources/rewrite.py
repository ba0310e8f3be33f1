"""Writing office documents anew: replacements inside the archive, link targets, and proof that nothing is left."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.docx import blocks_of

_PARTS = re.compile(r"^word/(document|header\d*|footer\d*|comments|footnotes|endnotes)\.xml$")
_TEXTS = ("w:t", "w:delText")
SCHEMA = "path string, doc_id string, content binary, n_applied int, not_found array<string>, remaining array<string>, warning string"


def _texts(xml: bytes) -> list[list[tuple[str, int, int, int, str]]]:
    """For every outermost paragraph its text elements: (tag, start of tag, start of content, end of content, text)."""
    found, open_, depth = [], None, 0
    p = expat.ParserCreate()

    def start(tag, _):
        nonlocal open_, depth
        if tag == "w:p":
            depth += 1
            if depth == 1:
                found.append([])
        elif tag in _TEXTS and depth:
            open_ = [tag, p.CurrentByteIndex, -1, []]

    def data(text):
        if open_ is not None:
            if open_[2] < 0:
                open_[2] = p.CurrentByteIndex
            open_[3].append(text)

    def end(tag):
        nonlocal open_, depth
        if tag == "w:p":
            depth -= 1
        elif open_ is not None and tag == open_[0]:
            if open_[2] >= 0:
                found[-1].append((tag, open_[1], open_[2], p.CurrentByteIndex, "".join(open_[3])))
            open_ = None

    p.StartElementHandler, p.CharacterDataHandler, p.EndElementHandler = start, data, end
    p.Parse(xml, True)
    return found


def replaced_runs(runs: list[str], replacements: list[tuple[str, str]]) -> tuple[list[str], int, set[str]]:
    """Runs of one paragraph after literal replacements that may cross them; the first run that a match touches takes the new text."""
    runs, applied, seen = list(runs), 0, set()
    for search, new in replacements:
        flat = "".join(runs)
        at, spots = flat.find(search), []
        while at >= 0:
            spots.append(at)
            at = flat.find(search, at + len(search))
        for at in reversed(spots):
            lo, put = 0, False
            for i, run in enumerate(runs):
                hi = lo + len(run)
                if lo < at + len(search) and hi > at:
                    a, b = max(at - lo, 0), min(at + len(search) - lo, len(run))
                    runs[i], put = run[:a] + ("" if put else new) + run[b:], True
                lo = hi
        if spots:
            applied += len(spots)
            seen.add(search)
    return runs, applied, seen


def rewrite(raw: bytes, replacements: list[tuple[str, str]]) -> tuple[bytes, int, list[str]]:
    """A document after literal replacements, longest first: ``(bytes, applied, searches not found)``.

    A file that is no archive is rewritten as plain text.  Bytes outside changed
    text elements and link targets stay as they are; other parts are copied.
    """
    todo = sorted({(s, r) for s, r in replacements if s}, key=lambda x: (-len(x[0]), x))
    applied, seen = 0, set()
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        (text,), applied, seen = replaced_runs([raw.decode("utf-8", "replace")], todo)
        return text.encode(), applied, [s for s, _ in todo if s not in seen]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for entry in old.infolist():
            body = old.read(entry)
            if _PARTS.match(entry.filename):
                splices = []
                for paragraph in _texts(body):
                    for tag in _TEXTS:
                        each = [x for x in paragraph if x[0] == tag]
                        runs, n, hit = replaced_runs([x[4] for x in each], todo)
                        applied, seen = applied + n, seen | hit
                        splices += [(x, run) for x, run in zip(each, runs, strict=True) if run != x[4]]
                for (_, tag_at, lo, hi, _), run in sorted(splices, key=lambda x: -x[0][2]):
                    head = body[tag_at:lo]
                    if b"xml:space" not in head:
                        head = head[:-1] + b' xml:space="preserve">'
                    body = body[:tag_at] + head + escape(run).encode() + body[hi:]
            elif entry.filename.startswith("word/_rels/") and entry.filename.endswith(".rels"):
                def target(m):
                    nonlocal applied
                    value = m[2]
                    for s, r in todo:
                        quoted = escape(s, {'"': "&quot;"})
                        if quoted in value:
                            applied += value.count(quoted)
                            seen.add(s)
                            value = value.replace(quoted, escape(r, {'"': "&quot;"}))
                    return m[1] + value + '"'

                links = lambda m: re.sub(r'(\bTarget=")([^"]*)"', target, m[0]) if "External" in m[0] else m[0]
                body = re.sub(r"<Relationship\b[^>]*>", links, body.decode("utf-8")).encode()
            new.writestr(entry, body)
    return out.getvalue(), applied, [s for s, _ in todo if s not in seen]


def rewrite_documents(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """``files(path, doc_id, content)`` written anew with the ``replacements(doc_id, search, replace)`` of their document.

    ``remaining`` lists searches that the new text still holds and that no
    replacement put there; a file that can't be read gives no content and a warning.
    """
    each = replacements.groupBy("doc_id").agg(F.collect_set(F.struct("search", "replace")).alias("todo"))
    joined = files.select("path", "doc_id", "content").join(each, "doc_id", "left").select("path", "doc_id", "content", F.coalesce("todo", F.expr("cast(array() as array<struct<search:string,replace:string>>)")).alias("todo"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for where, doc_id, raw, todo in zip(b["path"], b["doc_id"], b["content"], b["todo"], strict=True):
                pairs = [(x["search"], x["replace"] or "") for x in todo if x["search"]]
                try:
                    body, n, missing = rewrite(raw, pairs)
                    text = "\n".join(t for _, t in blocks_of(body))
                    put = [r for _, r in pairs]
                    left = sorted({s for s, _ in pairs if s in text and not any(s in r for r in put)})
                    rows.append((where, doc_id, body, n, missing, left, None))
                except (zipfile.BadZipFile, expat.ExpatError, KeyError, UnicodeDecodeError, SyntaxError) as e:
                    rows.append((where, doc_id, None, 0, [], [], str(e)))
            yield pd.DataFrame(rows, columns=["path", "doc_id", "content", "n_applied", "not_found", "remaining", "warning"])

    return joined.mapInPandas(run, SCHEMA)
