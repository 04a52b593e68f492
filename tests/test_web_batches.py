"""Elements and rules of a batch of many files leave in small tables."""

from __future__ import annotations

import pyarrow as pa

from skein.functions import web

SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary())])


class Given:
    """Takes what a function gives to mapInArrow or mapInPandas."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return lambda b: [(t.num_rows, t.to_pylist()) for t in run(iter([b]))]

    def mapInPandas(self, run, _):  # noqa: N802
        return lambda b: [(len(t), t.to_dict("records")) for t in run(iter([b.to_pandas()]))]


def test_a_batch_leaves_in_small_tables():
    html = pa.RecordBatch.from_pylist([{"path": str(k), "content": b"<ul id=a class='x y'>" + b"<li>" * 49} for k in range(1000)] + [{"path": "none", "content": None}], schema=SCHEMA)
    tables = web.elements(Given())(html)
    assert sum(n for n, _ in tables) == 50_000 and max(n for n, _ in tables) <= 10_000
    rows = [r for _, t in tables for r in t]
    assert rows[50] == {"file": "1", "element": 0, "tag": "ul", "dom_id": "a", "classes": ["x", "y"], "parent": None, "line": 1, "col": 0, "reference": None}
    assert [r["element"] for r in rows[:100]] == [*range(50)] * 2 and rows[51]["parent"] == 0
    css = pa.RecordBatch.from_pylist([{"path": str(k), "content": b"a, b { }" * 10} for k in range(1000)], schema=SCHEMA)
    tables = web.style_rules(Given())(css)
    assert sum(n for n, _ in tables) == 20_000 and max(n for n, _ in tables) <= 10_000
