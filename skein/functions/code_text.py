"""What code tells about itself: what routines of SQL hold, and names in their parts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.blocks import returns
from skein.functions.sql_lineage import blanked, lineage

_SQL = re.compile(r"'(?:''|[^'])*'|\"[^\"]*\"|\$(\w*)\$[\s\S]*?\$\1\$|--[^\n]*|/\*[\s\S]*?\*/|\w+|\S")


def _words(statement: str) -> list[tuple[str, str, int, int]]:
    """(lower-case word, text, start, end) of the tokens of a statement; literals and comments are one token each."""
    return [(m[0].lower(), m[0], m.start(), m.end()) for m in _SQL.finditer(statement) if not m[0].startswith(("--", "/*"))]


def routine_text(statement: str) -> str:
    """What a routine's statement holds: a dollar-quoted text, the literal after AS, or what stands between its outermost BEGIN and END."""
    found = _words(statement)
    for k, (word, text, start, end) in enumerate(found):
        if word.startswith("$") and text.endswith("$") and len(text) > 1:
            tag = text.index("$", 1) + 1
            return statement[start + tag : end - tag]
        if word[0] in "'\"" and k and found[k - 1][0] == "as":
            return text[1:-1]
    begins, ends = ([k for k, x in enumerate(found) if x[0] == w] for w in ("begin", "end"))
    return statement[found[begins[0]][3] : found[ends[-1]][2]] if begins and ends and ends[-1] > begins[0] else ""


def trigger_text(statement: str) -> str:
    """When a trigger fires and on what: the words from BEFORE, AFTER or INSTEAD OF up to ON."""
    found = _words(statement)
    begin = next((k for k, x in enumerate(found) if x[0] in ("before", "after") or x[0] == "instead" and k + 1 < len(found) and found[k + 1][0] == "of"), None)
    end = next((k for k in range(begin or 0, len(found)) if found[k][0] == "on"), None)
    if begin is None or end is None or end - begin < 2:
        return "unknown"
    return re.sub(r" (?=,)", "", " ".join(x[1] for x in found[begin:end]))


def touched_tables(body: str) -> list[tuple[str, str]]:
    """(table, relation) of what a routine's body writes and reads, by the lineage of its statements."""
    how = {"writes": "writes", "reads": "reads", "joins": "reads"}
    return list(dict.fromkeys((table, how[relation]) for part in blanked(body).split(";") for relation, table, _ in lineage(part) if relation in how))


def _mapped(column: Column, f, kind: str) -> Column:  # noqa: ANN001
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t or "") for t in texts], dtype=object)

    return run(column)


def routine_body(statement: Column) -> Column:
    return _mapped(statement, routine_text, "string")


def trigger_event(statement: Column) -> Column:
    return _mapped(statement, trigger_text, "string")


def routine_tables(body: Column) -> Column:
    """Tables that a body names, each as a struct of table and relation; comments and literals don't count."""
    return _mapped(body, lambda t: [{"table": a, "relation": b} for a, b in touched_tables(t)], "array<struct<table:string,relation:string>>")


def return_behavior(body: Column) -> Column:
    """What the return statements of a body (masked) tell."""
    return _mapped(body, returns, "string")


def without_generics(name: Column) -> Column:
    """A type's name without what stands in angle brackets however deep, array marks and question marks."""
    deep = F.regexp_replace(name, r"[^<>]", "")
    step = lambda left, _: F.regexp_replace(left, r"<[^<>]*>", "")
    plain = F.aggregate(F.sequence(F.lit(0), F.length(deep)), name, step)
    return F.trim(F.regexp_replace(plain, r"(\[\s*\])+|\?$|\.\.\.$", ""))


def _leaves(text: str, separator: str) -> list[str]:
    """The members of nested braces with what stands before each: a::{b, c::{d}} gives a::b and a::c::d."""
    out, before, held = [], [], ""
    for part in re.split(r"([{},])", text):
        if part == "{":
            before.append(held.strip())
            held = ""
        elif part in ("}", ","):
            if held.strip():
                out.append("".join([*before, held.strip()]))
            held = ""
            if part == "}" and before:
                before.pop()
        else:
            held += part
    if held.strip():
        out.append("".join([*before, held.strip()]))
    return [re.sub(rf"(?:{re.escape(separator)})+$", "", x) for x in out]


def rust_uses(text: str) -> list[tuple[str, str, bool]]:
    """(path, local name, whether all of it) for each name that a use declaration brings in."""
    body = re.sub(r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+|\s*;?\s*$", "", text)
    out = []
    for leaf in _leaves(body, "::"):
        path, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", "\0", leaf).partition("\0"))
        if path.endswith("::*") or path == "*":
            out.append((path[:-3], "", True))
            continue
        path = re.sub(r"::self$", "", path)
        if path:
            out.append((path, alias or path.rsplit("::", 1)[-1], False))
    return out


def php_uses(text: str) -> list[tuple[str, str, str]]:
    """(kind, path, local name) for each name that a namespace use brings in."""
    m = re.match(r"(?is)^\s*use\s+(?:(function|const)\s+)?(.+?)\s*;?\s*$", text)
    out = []
    for leaf in _leaves(m[2], "\\") if m else []:
        path, _, alias = (x.strip() for x in re.sub(r"(?i)\s+as\s+", "\0", leaf).partition("\0"))
        if path := path.strip("\\").replace(" ", ""):
            out.append(((m[1] or "class").lower(), path, alias or path.rsplit("\\", 1)[-1]))
    return out


def utc_text(moment: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with a Z, by whole seconds."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
