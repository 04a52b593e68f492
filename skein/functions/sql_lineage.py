"""Statements of SQL scripts and the tables that they read, write, join and define."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPAQUE = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:''|[^'])*(?:'|\Z)|\$(?P<tag>\w*)\$[\s\S]*?(?:\$(?P=tag)\$|\Z)")
_NAME = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
_TABLE = rf"(?P<table>{_NAME}(?:\s*\.\s*{_NAME}){{0,2}})"
_TOKEN = re.compile(
    rf"\b(?:(?P<ctes>WITH(?:\s+RECURSIVE)?)\b|(?P<insert>(?:INSERT|MERGE|REPLACE)\s+(?:IGNORE\s+)?(?:OVERWRITE\s+)?INTO(?:\s+TABLE)?)\s+|(?P<update>UPDATE)\s+|(?P<delete>DELETE\s+FROM)\s+|(?P<truncate>TRUNCATE(?:\s+TABLE)?)\s+"
    rf"|(?P<define>CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?P<what>TABLE|(?:MATERIALIZED\s+)?VIEW)(?:\s+IF\s+NOT\s+EXISTS)?)\s+|(?P<references>REFERENCES)\s+"
    rf"|(?P<join>(?:(?P<side>LEFT|RIGHT|FULL)\s+(?:OUTER\s+)?|(?P<kind>INNER|CROSS)\s+)?JOIN)\s+|(?P<read>FROM|USING)\s+){_TABLE}?",
    re.I,
)
_CTE = re.compile(rf"(?:\bWITH(?:\s+RECURSIVE)?|,)\s*(?P<name>{_NAME})\s*(?:\([^()]*\)\s*)?AS\s*(?:NOT\s+MATERIALIZED\s*|MATERIALIZED\s*)?\(", re.I)
_NOT_TABLES = frozenset("select lateral unnest values set where only".split())


class Statement(NamedTuple):
    number: int
    text: str
    start: int
    end: int


def blanked(text: str) -> str:
    """text with comments, strings and dollar-quoted bodies as spaces; offsets stay."""
    return _OPAQUE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def statements(text: str, product: str = "sql") -> list[Statement]:
    """Parts between delimiters: ; by default, what DELIMITER names (mysql), lines of GO (tsql), lines of / (oracle)."""
    code, cuts, delimiter, at = blanked(text), [], ";", 0
    for line in re.finditer(r"[^\n]*(?:\n|\Z)", code):
        bare = line[0].strip()
        if product == "mysql" and (m := re.fullmatch(r"(?i)delimiter\s+(\S+)", bare)):
            cuts.append((line.start(), line.end()))
            delimiter = m[1]
        elif product == "tsql" and re.fullmatch(r"(?i)go(?:\s+\d+)?", bare) or product == "oracle" and bare == "/":
            cuts.append((line.start(), line.end()))
        else:
            cuts += [(line.start() + m.start(), line.start() + m.end()) for m in re.finditer(re.escape(delimiter), line[0])]
    out = []
    for start, end in [*cuts, (len(text), len(text))]:
        part = text[at:start]
        if code[at:start].strip():
            begin = at + len(part) - len(part.lstrip())
            out.append(Statement(len(out), part.strip(), begin, at + len(part.rstrip())))
        at = end
    return out


def _plain(name: str) -> str:
    return ".".join(p.strip().strip('"`[]') for p in name.split("."))


def lineage(statement: str) -> list[tuple[str, str, str]]:
    """(relation, table, clause) for every table occurrence; a name that the statement's WITH defines is no table."""
    code = blanked(statement)
    ctes = {_plain(m["name"]).casefold() for m in _CTE.finditer(code)} if re.search(r"(?i)\bWITH\b", code) else set()
    out = []
    for m in _TOKEN.finditer(code):
        name = m["table"] and _plain(m["table"])
        if not name or m["ctes"] or name.casefold() in _NOT_TABLES:
            continue
        if m["update"] and re.search(r"(?i)\b(?:ON\s+(?:DUPLICATE\s+KEY|CONFLICT|DELETE)|FOR|DO)\s*$", code[: m.start()]):
            continue
        if m["insert"] or m["update"] or m["delete"] or m["truncate"]:
            out.append(("writes", name, "target"))
        elif m["define"]:
            out.append(("defines", name, m["what"].lower()))
        elif m["references"]:
            out.append(("references", name, "foreign key"))
        elif name.casefold() not in ctes:
            out.append(("joins", name, (m["side"] or m["kind"] or "inner").lower()) if m["join"] else ("reads", name, "source"))
    return out


def table_edges(scripts: DataFrame, path_col: str = "path", text_col: str = "text", product_col: str | None = None) -> DataFrame:
    """(path, statement, relation, table, clause) of scripts; a null script has no statements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, s.number, *x) for p, t, k in zip(b["path"], b["text"], b["product"], strict=True) for s in statements(t or "", k or "sql") for x in lineage(s.text)]
            yield pd.DataFrame(rows, columns=["path", "statement", "relation", "table", "clause"])

    product = F.col(product_col) if product_col else F.lit("sql")
    return scripts.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), product.alias("product")).mapInPandas(run, "path string, statement int, relation string, table string, clause string")
