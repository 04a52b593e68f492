from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import components, html_text, neighbours, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy now</div><header>Site</header>
<article><h1>Head &amp; title</h1><p><b>First</b>&nbsp;para<br>line two<p>Second <i>pa</i>ra with some more words in it</p><ul><li>x</li><li>y</li></ul>
<aside>Related</aside><form>Name <input></form></article>
<div id="comments"><article><p>A reader says a lot of things here that are no part of it</p></article></div>
<div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Head & title First para line two Second para with some more words in it x y"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("no tags at all", "no tags at all"), ("<article>a<script>x</script>b</article>", "ab"),
        ("<nav><ul><li>a<div class=ad>x<article><p>body</article>", "body"), ("<article><p>one</p>&lt;two&gt;</article>", "one <two>"),
        ("<article><pre>a\n\t b</pre></article>", "a b"), ("<script>" + "x" * 9, ""),
    ],
)
def test_html_cases(html, text):
    assert html_text.main_text(html) == text


def test_html_by_ratio_without_article():
    body = "".join(f"<p>{'long words of the main text ' * 6}</p>" for _ in range(5))
    menu = "".join(f"<li><a href=x>item {i}</a></li>" for i in range(12))
    got = html_text.main_text(f"<body><div><ul>{menu}</ul></div><div><h1>Title</h1>{body}<p>short</p>{body}</div><div><ul>{menu}</ul></div></body>")
    assert got.startswith("Title long words") and "short" in got and "item" not in got


def test_html_clusters_choose_among_articles_and_drop_lists_of_links():
    body = "".join(f"<p>{'long words of the main text ' * 6}</p>" for _ in range(5))
    teasers = "".join(f"<article><a href=x>teaser {i}</a></article>" for i in range(8))
    inside = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(9))
    page = f"<body>{teasers}<article><h1>Title</h1>{body}<p>see <a href=x>here</a></p><ul>{inside}</ul></article></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title long words") and got.endswith("see here") and "teaser" not in got and "link" not in got
    every = html_text.upper_cluster
    try:  # without the clusters all that stays
        html_text.upper_cluster = lambda v: np.ones(len(v), bool)
        assert "teaser" in html_text.main_text(page) and "link 3" in html_text.main_text(page)
    finally:
        html_text.upper_cluster = every


def test_html_ratio_threshold_matches_brute_force():
    """Two clusters of the smoothed logarithms by trying every threshold that 2-means may settle at."""
    r = np.random.default_rng(8)
    for _ in range(50):
        v = np.concatenate([r.uniform(0, 2, r.integers(2, 30)), r.uniform(3, 6, r.integers(2, 30))])
        up = html_text.upper_cluster(v)
        assert v[up].min() > v[~up].max()
        cut = (v[up].mean() + v[~up].mean()) / 2
        assert ((v > cut) == up).all()
        kernel = [np.exp(-0.5 * d * d) for d in range(-3, 4)]
        want = [sum(k * v[i + d] for d, k in zip(range(-3, 4), kernel, strict=True) if 0 <= i + d < len(v)) / sum(k for d, k in zip(range(-3, 4), kernel, strict=True) if 0 <= i + d < len(v)) for i in range(len(v))]
        assert np.allclose(html_text.smoothed(v), want)


def test_html_without_marked_articles_gives_the_same_text(spark):
    """The clusters find the articles of the given pages when nothing marks them."""
    pages = [x.html for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    plain = [html_text.main_text(h.replace("<article", "<div").replace("</article", "</div")) if h else "" for h in pages]
    same = sum(a == html_text.main_text(h) for a, h in zip(plain, pages, strict=True))
    assert same >= 0.9 * len(pages)


def test_html_unmatched_tags_take_no_quadratic_time():
    n = 60_000
    assert html_text.main_text("<article>" + "<i>" * n + "x" + "</b>" * n + "</article>") == "x"
    assert html_text.main_text("<b><article>" + "<i>" * n + "x" + "</b>" * n + "</article>") == "x"


def test_html_long_page():
    n = 20_000
    assert html_text.main_text("<article>" + "<p>word here</p>" * n + "</article>") == " ".join(["word here"] * n)


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert sorted((str(x.page_id), len(x.text) == x.n_chars) for x in got) == [("1", True), ("1", True), ("2", True), ("None", True)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, "allow"
    r = max(fit, key=lambda r: len(r.host + r.path))
    return host, path, r.host + r.path, r.verdict


URLS = [None, "", "no", "http://A.Example.com/en/1", "https://www.example.com/en/x?q#f", "ftp://x.net/es/", "http://net/fr/y", "http://xnet/fr/", "//a.com/", "http://a.com", "http://a.com/?u=http://b.net/es/", "x://É.net/es/\n/b", "http://b.org#://c.com/", "HTTP://WWW.EXAMPLE.COM/en/", "http://a.net/en/"]


def test_url_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "component": F.lit(1)})
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judge(spark, pages, urls.links(pages)).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(URLS)}


def test_blocks_follow_aliases_but_allow_goes_first(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.org/x", link.format("https://b.net/es/1")), (2, "http://c.org/y", '<META http-equiv="refresh" content="0; URL=http://a.org/x#top">'),
        (3, "http://d.org/z", "<p>canonical</p>"), (4, "http://e.org/1", link.format("http://b.net/fr/2")), (5, "http://e.org/1", None),
        (6, "http://a.com/ok", link.format("http://e.org/1")), (7, "http://f.org/1", link.format("/2")), (8, "http://f.org/2", None), (9, "http://a.org/x", None), (10, None, link.format("http://b.net/es/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.verdict for x in urls.judge(spark, pages, urls.links(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<link rel=canonical href="page.html">', ["http://a.org/en/page.html"]), ('<link rel="canonical" href="../fr/x">', ["http://a.org/fr/x"]), ("<link rel='canonical' href='?id=3'>", ["http://a.org/en/p?id=3"]),
        ('<link rel="nofollow canonical" href="/q?a=1&amp;b=2">', ["http://a.org/q?a=1&b=2"]), ('<link rel=canonical href="/1"><LINK href="/2" rel=Canonical>', ["http://a.org/1", "http://a.org/2"]),
        ('<base href="http://b.org/d/"><link rel=canonical href=e>', ["http://b.org/d/e"]), ('<link rel=canonical href=e><base href="/f/">', ["http://a.org/f/e"]), ('<link rel=canonical href="//c.org/x?u=http://d.org">', ["http://c.org/x?u=http://d.org"]),
        ('<meta http-equiv=refresh content="0;url=x"><meta http-equiv=refresh content="5; URL=\'y\'"><meta http-equiv=refresh content="3">', ["http://a.org/en/x", "http://a.org/en/y"]),
        ('<!-- <link rel=canonical href="/1"> --><p>canonical</p><link rel=canonical href="mailto:x"><link rel=canonical href="http://[">', []),
    ],
)
def test_links_are_resolved_as_browsers_do(spark, html, want):
    pages = spark.createDataFrame([("x://a.org/en/p", html)], "url string, html string")
    got = [x.target for x in urls.links(pages).collect()]
    assert [g.split("://", 1)[1] for g in got] == [w.split("://", 1)[1] for w in want]


def test_components_match_union_find(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {x.node: x.component for x in components.connected_components(spark, rows).collect()}
    assert got == {a: find(a) for a in root}
    assert components.connected_components(spark, rows.where("false")).count() == 0


def exact(rows, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            near = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(90)]
    rows += [(100 + i, [1.0] * 8) for i in range(40)] + [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8), (280, [None] + [1.0] * 7), (300, [1.0, 2.0]), (0, rows[0][1]), (None, [1.0] * 8), (320, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "cell": F.lit(2), "score": F.lit("x")})
    got = neighbours.nearest(spark, df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))).collect()
    want = exact(rows, 20)
    found = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    hits = sum(len({j for j, _ in want[q]} & {j for _, j, _ in v}) for q, v in found.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    for v in found.values():
        assert [r for r, *_ in v] == list(range(1, len(v) + 1))
        assert v == sorted(v, key=lambda x: (-round(x[2], 9), x[1]))
    assert neighbours.nearest(spark, df.where("false"), F.lit(True)).count() == 0


def test_neighbours_when_nothing_is_better():
    best = neighbours._Best(2)
    m = np.eye(3)
    best.meet(np.array([1, 2]), m[:2], np.array([7, 8, 9]), m, np.array([5.0, 5.0]))
    assert list(best.rows()) == []
    best.meet(np.array([1, 2]), m[:2], np.array([7, 8, 9]), m, np.array([-np.inf, 1.0]))
    (b,) = best.rows()
    assert b.to_pydict() == {"query": [1, 2], "entries": [[7, 8], [8]], "scores": [[1.0, 0.0], [1.0]]}


def test_probes_come_in_the_order_of_their_cost():
    for bits in (1, 3, 5):
        inside = np.random.default_rng(bits).random((4, 2, bits))
        cell = np.zeros((4, 2, bits), np.int64)
        many = neighbours.visited(cell, inside, bits, 3**bits)
        assert many.shape[2] == 3**bits and (many[:, :, 0] == 0).all()
        price = (np.where(many < 0, inside[:, :, None] ** 2, 0) + np.where(many > 0, (1 - inside[:, :, None]) ** 2, 0)).sum(-1)
        assert (np.diff(price, axis=2) >= -1e-12).all() and len({tuple(x) for x in many[0, 0].tolist()}) == 3**bits
        assert (neighbours.ranks(cell, inside, many.transpose(0, 2, 1, 3), bits) == np.arange(3**bits)[None, :, None]).all()


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    r = np.random.default_rng(2)
    centres = r.standard_normal((30, 32)) * 2
    m = (centres[r.integers(0, 30, 4000)] + r.standard_normal((4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(spark, df, F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 4000, 20):
        s = m.astype(float) @ m[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & {x.vec_id for x in got if x.query_id == q})
    assert hit / (200 * 20) >= 0.9


@pytest.mark.parametrize("rare", [False, True])
def test_neighbours_of_isolated_queries_and_rare_lengths(spark, monkeypatch, rare):
    monkeypatch.setattr(neighbours, "BLOCK", 2, raising=False)
    r = np.random.default_rng(4)
    tight = np.float32(np.eye(8)[0] + 0.01 * r.standard_normal((2000, 8)))
    rows = [(i * 20 + 1, v.tolist()) for i, v in enumerate(tight)] + [(20 * i, [float(x) for x in -np.eye(8)[i % 8]]) for i in range(1, 9)]
    if rare:
        rows += [(20 * i, [float(x) for x in r.standard_normal(3)]) for i in range(10, 19)] + [(400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = exact(rows, 20), {}
    for x in neighbours.nearest(spark, df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert {q: len(got.get(q, [])) for q in want} == {q: len(v) for q, v in want.items()}
    assert all(set(got[20 * i]) == {j for j, _ in want[20 * i]} for i in range(10, 19) if rare)
