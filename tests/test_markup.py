"""HTML, CSS, SQL and lookups of scripts in the graph of a tree."""

from __future__ import annotations

import pytest

from skein.operators import validate
from skein.plans.analyze import analyze
from skein.plans.markup import _under

FILES = {
    "web/index.html": '<html><head><link rel="stylesheet" href="./css/main.css?v=1"><script src="app.js"></script><script src="https://cdn.example.org/x.js"></script></head><body><div id="top" class="box"><p class="big">x</p></div></body></html>',
    "web/css/main.css": "@import url('more.css');\n.box, #top { color: red }\ndiv > p { x: y }\n.none { }\n",
    "web/css/more.css": "p { a: b }",
    "web/app.js": "import { a } from './lib';\ndocument.getElementById('top').addEventListener('click', f);\nconst q = document.querySelector('.gone');\nfunction f() { document.getElementById('top'); }\n",
    "db/a.sql": "CREATE TABLE shop.orders (id int);\nINSERT INTO shop.orders SELECT * FROM staging s LEFT JOIN customers c ON 1=1;\n",
    "db/r.pgsql": "CREATE FUNCTION tidy() RETURNS void AS $$ BEGIN DELETE FROM shop.orders; INSERT INTO log SELECT * FROM shop.orders; END $$ LANGUAGE plpgsql;\nCREATE TRIGGER t BEFORE INSERT ON shop.orders FOR EACH ROW EXECUTE FUNCTION tidy();\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("markup")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return analyze(spark, str(root))


def test_markup(graph):
    assert [tuple(r) for r in validate.violations(graph).collect()] == []
    name = {r.id: (r.kind, r.qualified_name) for r in graph.nodes.collect()}
    edges = {(r.relation_type, name[r.source_id][1], name[r.target_id][1], r.resolution_status) for r in graph.edges.collect()}
    top, big = "web/index.html:div#top@6", "web/index.html:p@7"
    want = {
        ("imports", "web/index.html", "web/css/main.css", "resolved"), ("imports", "web/index.html", "web/app.js", "resolved"), ("imports", "web/index.html", "https://cdn.example.org/x.js", "external"), ("imports", "web/css/main.css", "web/css/more.css", "resolved"),
        ("contains", top, big, "resolved"), ("styles", "web/css/main.css:.box", top, "resolved"), ("styles", "web/css/main.css:#top", top, "resolved"), ("styles", "web/css/more.css:p", big, "resolved"),
        ("handles", "web/app.js", top, "resolved"), ("references", "web/app.js", top, "resolved"), ("references", "web/app.js", ".gone", "unresolved"),
        ("defines", "db/a.sql:0", "shop.orders", "resolved"), ("writes", "db/a.sql:1", "shop.orders", "resolved"), ("reads", "db/a.sql:1", "staging", "external"), ("joins", "db/a.sql:1", "customers", "external"),
        ("writes", "db/r.pgsql:0", "log", "external"), ("defines", "db/r.pgsql:0", "tidy", "resolved"), ("triggers", "db/r.pgsql:1", "shop.orders", "external"), ("defines", "db/r.pgsql:1", "t", "resolved"),
    }
    assert want <= edges, sorted(want - edges) + sorted(edges)
    codes = {r.code for r in graph.diagnostics.collect()}
    assert {"unsupported_construct", "unresolved_dom_reference"} <= codes
    assert not any(e[0] == "styles" and e[1].endswith(".none") for e in edges)


def test_paths(spark):
    rows = [("a/b/c.html", "../x.css", "a/x.css"), ("c.html", "./y.js", "y.js"), ("a/c.html", "/z/q.css?k#l", "z/q.css"), ("a/b.html", "../../up.css", "../up.css")]
    df = spark.createDataFrame(rows, "p string, r string, w string")
    assert [r[0][0] for r in df.select(_under(df.p, df.r)).collect()] == [w for *_, w in rows]
