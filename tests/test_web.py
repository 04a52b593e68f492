from __future__ import annotations

from skein.functions.web import elements, selectors, style_rules
from skein.operators import web

HTML = b'<html><body><div id="top" class="box big"><br><P class="big">x</P></div><p>y</body></html>'
CSS = b"/* .no{} */ .big, #top { color: red }\n@media print { p { x: y } }\ndiv > p {}\n.none {}"


def test_elements_and_styles(spark):
    files = spark.createDataFrame([("a.html", HTML), ("b.html", None)], "path string, content binary")
    found = elements(files)
    rows = {r.element: (r.tag, r.dom_id, r.classes, r.parent) for r in found.collect()}
    assert rows == {0: ("html", None, [], None), 1: ("body", None, [], 0), 2: ("div", "top", ["box", "big"], 1), 3: ("br", None, [], 2), 4: ("p", None, ["big"], 2), 5: ("p", None, [], 1)}
    rules = style_rules(spark.createDataFrame([("s.css", CSS)], "path string, content binary"))
    got = {(r.selector, r.element, r.status) for r in web.styles(rules, found).collect()}
    assert got == {(".big", 2, "resolved"), (".big", 4, "resolved"), ("#top", 2, "resolved"), ("p", 4, "resolved"), ("p", 5, "resolved"), ("div > p", None, "unsupported")}


def test_references(spark):
    found = elements(spark.createDataFrame([("a.html", HTML)], "path string, content binary"))
    refs = spark.createDataFrame([(1, "#top"), (2, "#gone"), (3, "DIV"), (4, "a b")], "ref int, selector string")
    got = sorted((r.ref, r.element, r.status) for r in web.matches(refs, found).collect())
    assert got == [(1, 2, "resolved"), (2, None, "unresolved"), (3, 2, "resolved"), (4, None, "unsupported")]


def test_selectors():
    assert selectors("a,b{} @x{c{}}") == [("a", 0), ("b", 2), ("c", 9)]
