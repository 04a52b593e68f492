"""Elements of HTML files and rules of CSS files, as rows."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

ELEMENTS = "file string, element int, tag string, dom_id string, classes array<string>, parent int, line int, col int, reference string"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.open: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        line, col = self.getpos()
        self.rows.append((len(self.rows), tag, values.get("id"), (values.get("class") or "").split(), self.open[-1][1] if self.open else None, line, col, values.get("src") if tag == "script" else values.get("href") if tag == "link" else None))
        if tag not in _VOID:
            self.open.append((tag, len(self.rows) - 1))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break


#: Elements or rules that are given out together, so that a worker's memory follows from the longest file, not from the files of a batch.
TOGETHER = 8192
_SCHEMA = pa.schema([("file", pa.string()), ("element", pa.int32()), ("tag", pa.string()), ("dom_id", pa.string()), ("classes", pa.list_(pa.string())), ("parent", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("reference", pa.string())])


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(path, text), one file at a time."""
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            yield path.as_py(), (content.as_py() or b"").decode("utf-8", "replace")


def _tables(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as tables of TOGETHER rows at most."""
    rows = iter(rows)
    while held := list(itertools.islice(rows, TOGETHER)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for path, text in _files(batches):
        p = _Elements()
        p.feed(text)
        p.close()
        yield from ((path, *r) for r in p.rows)


def elements(files: DataFrame) -> DataFrame:
    """Elements of (path, content) rows, with the element that holds each; null content has none."""
    return files.select("path", "content").mapInArrow(lambda batches: _tables(_elements(batches), _SCHEMA), ELEMENTS)


def selectors(css: str) -> list[tuple[str, int]]:
    """(selector, offset) of a style sheet's rules, one for each part between commas; at-rules hold rules but are none."""
    code = re.sub(r"/\*[\s\S]*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), css)
    out = []
    for m in re.finditer(r"([^{};]+)\{", code):
        if m[1].strip().startswith("@"):
            continue
        at = m.start(1)
        for part in m[1].split(","):
            if part.strip():
                out.append((part.strip(), at + len(part) - len(part.lstrip())))
            at += len(part) + 1
    return out


def _rules(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for path, text in _files(batches):
        yield from ((path, *r) for r in selectors(text))


def style_rules(files: DataFrame) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("selector", pa.string()), ("start", pa.int32())])
    return files.select("path", "content").mapInArrow(lambda batches: _tables(_rules(batches), schema), "file string, selector string, start int")
