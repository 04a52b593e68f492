"""URL filters: rules by host and path, and block decisions that follow redirects and canonical links.

Redirects and canonical links join urls into classes of aliases (distributed connected components).
A url that a rule fits keeps that rule's verdict. Any other url is blocked if a rule blocks one of its
aliases and none allows one: an explicit allow takes precedence over a block that arrives by an alias.

Links are resolved against the page's url, or the base it declares, after character references are decoded;
all canonical links and refresh redirects of a page count, with whatever other relations they name.

Defined results: null urls and urls without :// have empty host and path, fit no rule and have no
aliases (allow); null html has no links; repeated rows are judged alike; an empty table gives no rows;
further columns pass through judge(), but for columns named like its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: A refresh's delay, separator, url= and target; all but the target may be missing.
_TARGET = re.compile(r"""\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:'([^']*)|"([^"]*)|(.*))""", re.IGNORECASE | re.DOTALL)
_BLANK = " \t\n\f\r"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def node(url: Column) -> Column:
    """A url's name among aliases: scheme and fragment don't count, nor does an empty path differ from /. Null if it has no ://."""
    where = F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    return F.when(url.contains("://"), F.md5(F.concat(host(url), where, F.regexp_extract(url, _PARTS, 3))))


def rule_of(host_col: Column, path_col: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. Rules are a list in code, tried from the longest."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


class _Links(HTMLParser):
    """The base, and the canonical and refresh links, as a page writes them."""

    def __init__(self) -> None:
        super().__init__()
        self.base: str | None = None
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("base", "link", "meta"):
            return
        has = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        if tag == "base" and self.base is None and "href" in has:
            self.base = has["href"]
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split():
            self.found.append(has.get("href", ""))
        elif tag == "meta" and has.get("http-equiv", "").strip().lower() == "refresh" and (m := _TARGET.match(has.get("content", ""))):
            self.found.append(next((x for x in m.groups() if x), ""))


def targets(url: str, html: str) -> list[str]:
    """The absolute urls that a page declares as its canonical url or redirects to. Schemes don't count, so any base reads as http."""
    parser = _Links()
    parser.feed(html)
    parser.close()
    out, base = [], "http://" + url.split("://", 1)[1]
    for link in [parser.base or "", *parser.found]:
        link = re.sub(r"[\t\n\r]", "", link.strip(_BLANK))
        try:
            out.append(urljoin(base, link) if link else "")
        except ValueError:  # no url, such as http://[
            out.append("")
        if len(out) == 1 and "://" in out[0]:
            base = out[0]
    return [x for x in out[1:] if "://" in x]


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) for canonical links and refresh redirects that pages declare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["url", "target"])

    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    # the cheap test first: most pages have neither
    some = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    return pages.where(url.contains("://") & some).select(url.alias("url"), html.alias("html")).mapInArrow(run, "url string, target string")


def judge(spark: SparkSession, pages: DataFrame, edges: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict. edges: (url, target) pairs of aliases."""
    ends = edges.select(F.explode(F.array("url", "target")).alias("_sk_url"))
    named = edges.select(node(F.col("url")).alias("u"), node(F.col("target")).alias("v"))
    alias = connected_components(spark, named)
    ruled = ends.select(node(F.col("_sk_url")).alias("node"), rule_of(host(F.col("_sk_url")), path(F.col("_sk_url")), rules)["verdict"].alias("said")).where("node is not null and said is not null").distinct()
    said = alias.join(ruled, "node").groupBy("component").agg(F.max(F.col("said") == "block").alias("_sk_block"), F.max(F.col("said") == "allow").alias("_sk_allow"))
    blocked = alias.join(said.where("_sk_block and not _sk_allow"), "component").select(F.col("node").alias("_sk_node"), F.lit(True).alias("_sk_blocked"))
    out = pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col)), "_sk_node": node(F.col(url_col))})
    out = out.withColumn("_sk_rule", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "_sk_node", "left")
    own = F.when(F.col("_sk_blocked"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_sk_rule")["rule"], "verdict": F.coalesce(F.col("_sk_rule")["verdict"], own)}).drop("_sk_node", "_sk_rule", "_sk_blocked")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(spark, pages.select("page_id", "url"), links(pages)).select("page_id", "host", "path", "rule", "verdict")


#: The rules alone: the tables given declare neither canonical links nor redirects, so no verdict arrives by an alias.
ORACLE = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/fr/', 'net/es/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
