"""Definitions, bindings and references of source files: one parse per file, distributed by file.

Python files are parsed by the standard library. Other languages go by declarative profiles of regular
expressions over text whose comments and strings are masked, offsets kept.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from skein.functions.blocks import Blocks, Style, returns, style

#: record: node, binding, import, ref, variable, returns, command (arity: where its pipeline begins) or problem; the other columns are null where they don't apply. A variable's
#: target is the name of its type; arity is the number of parameters or arguments, owner the type a definition belongs to.
RECORDS = (
    "record string, file string, language string, id string, kind string, name string, qualified_name string, parent_id string, scope string, target string, module_name string, member string, relation string, "
    "chain array<string>, in_class string, signature string, return_behavior string, execution_kind string, start int, start_line int, start_col int, end_line int, end_col int, message string, arity int, owner string, receiver string"
)
_NAMES = [x.strip().split(" ")[0] for x in RECORDS.split(", ")]


def module_name(path: str) -> str:
    stem = re.sub(r"\.pyi?$", "", path)
    return re.sub(r"(^|/)__init__$", "", stem).replace("/", ".") or "__init__"


def _chain(node: ast.AST) -> list[str] | None:
    """a.b.c as its parts; None for any other expression."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *parts[::-1]] if isinstance(node, ast.Name) else None


class _Python(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path, self.rows, self.used = path, [], {}
        self.module = module_name(path)
        self.scope = self._node("module", self.module, self.module, None, None)
        self.names, self.classes = [], []

    def _add(self, record: str, node: ast.AST | None = None, **values) -> None:  # noqa: ANN003
        row = dict.fromkeys(_NAMES) | {"record": record, "file": self.path, "language": "python"} | values
        if node is not None and hasattr(node, "lineno"):
            row |= {"start_line": node.lineno, "start_col": node.col_offset, "end_line": node.end_lineno, "end_col": node.end_col_offset}
        self.rows.append(row)

    def _node(self, kind: str, name: str, qualified: str, parent: str | None, node: ast.AST | None, **values) -> str:  # noqa: ANN003
        base = f"python:{self.path}:{qualified}:{kind}"
        k = self.used[base] = self.used.get(base, -1) + 1
        id_ = base if not k else f"{base}~{k}"
        self._add("node", node, id=id_, kind=kind, name=name, qualified_name=qualified, parent_id=parent, **values)
        return id_

    def _define(self, node: ast.AST, kind: str, name: str, **values) -> str:  # noqa: ANN003
        qualified = ".".join([self.module, *self.names, name])
        id_ = self._node(kind, name, qualified, self.scope, node, **values)
        self._add("binding", node, scope=self.scope, name=name, target=id_)
        return id_

    def _inside(self, id_: str, label: list[str], body: list[ast.AST], in_class: str | None) -> None:
        keep = self.scope, self.names, self.classes
        self.scope, self.names, self.classes = id_, [*self.names, *label], [*self.classes, in_class]
        for x in body:
            self.visit(x)
        self.scope, self.names, self.classes = keep

    def _ref(self, relation: str, node: ast.AST, target: ast.AST) -> None:
        chain = _chain(target)
        inner, after = target, []
        while isinstance(inner, ast.Attribute):
            inner, after = inner.value, [inner.attr, *after]
        if after and isinstance(inner, ast.Call) and _chain(inner.func):  # f().g(): what f gives back has no name of its own
            name = f"<result>@{inner.lineno}:{inner.col_offset}:{inner.end_col_offset}"
            self._add("binding", inner, scope=self.scope, name=name, target=None)
            self._typed("call", inner, inner.func, self.scope, name)
            chain = [name, *after]
        self._add("ref", node, relation=relation, scope=self.scope, chain=chain, in_class=next((c for c in reversed(self.classes) if c), None), message=ast.unparse(target)[:240])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        for b in node.bases:
            self.visit(b)
        id_ = self._define(node, "class", node.name)
        for b in node.bases:
            keep, self.scope = self.scope, id_
            self._ref("inherits", b, b)
            self.scope = keep
        for x in (*node.decorator_list, *node.keywords):
            self.visit(x)
        self._inside(id_, [node.name], node.body, id_)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        own = list(_own_statements(node))
        returns = [x for x in own if isinstance(x, ast.Return)]
        with_value = [x for x in returns if x.value is not None and not (isinstance(x.value, ast.Constant) and x.value.value is None)]
        behaviour = "no_explicit_return" if not returns else "returns_value" if len(with_value) == len(returns) else "mixed" if with_value else "returns_none"
        yields = any(isinstance(x, ast.Yield | ast.YieldFrom) for x in own)
        is_async = isinstance(node, ast.AsyncFunctionDef)
        how = ("async_generator" if is_async else "generator") if yields else "async" if is_async else "sync"
        kind = "method" if self.classes and self.classes[-1] == self.scope else "function"
        id_ = self._define(node, kind, node.name, signature=("async def " if is_async else "def ") + f"{node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""), return_behavior=behaviour, execution_kind=how)
        for x in node.decorator_list:
            self.visit(x)
        args = node.args
        for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
            self._add("binding", a, scope=id_, name=a.arg, target=None)
            self._typed("annotation", a, a.annotation, id_, a.arg)
        self._typed("returns", node, node.returns, self.scope, None, target=id_)
        self._inside(id_, [node.name, "<locals>"], node.body, None)

    visit_FunctionDef = visit_AsyncFunctionDef = _function  # noqa: N815

    def visit_Lambda(self, node: ast.Lambda) -> None:  # noqa: N802
        qualified = ".".join([self.module, *self.names, f"<lambda>@{node.lineno}:{node.col_offset}"])
        id_ = self._node("lambda", "<lambda>", qualified, self.scope, node, execution_kind="sync")
        for a in node.args.args:
            self._add("binding", a, scope=id_, name=a.arg, target=None)
        self._inside(id_, ["<lambda>"], [node.body], None)

    def _typed(self, relation: str, node: ast.AST, says: ast.AST | None, scope: str, name: str | None, **values) -> None:  # noqa: ANN003
        """What a name holds or a function gives back, if an annotation or the called name tells."""
        if isinstance(says, ast.Constant) and isinstance(says.value, str):
            try:
                says = ast.parse(says.value, mode="eval").body
            except SyntaxError:
                return
        if says is not None and (chain := _chain(says)):
            self._add("variable" if name else "returns", node, relation=relation, scope=scope, name=name, chain=chain, message=".".join(chain), **values)

    def visit_Assign(self, node: ast.Assign) -> None:  # noqa: N802
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call):
            self._typed("call", node, node.value.func, self.scope, node.targets[0].id)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:  # noqa: N802
        if isinstance(node.target, ast.Name):
            self._typed("annotation", node, node.annotation, self.scope, node.target.id)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        if isinstance(node.ctx, ast.Store):
            self._add("binding", node, scope=self.scope, name=node.id, target=None, message="assigned")

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            local = a.asname or a.name.split(".")[0]
            self._add("import", node, relation="imports", scope=self.scope, name=local, module_name=a.name if a.asname else a.name.split(".")[0], message=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        base = node.module or ""
        if node.level:
            at = self.module.split(".") if self.path.endswith("__init__.py") else self.module.split(".")[:-1]
            at = at[: len(at) - node.level + 1]
            base = ".".join([*at, *([base] if base else [])])
        for a in node.names:
            self._add("import", node, relation="imports", scope=self.scope, name=a.asname or a.name, module_name=base, member=None if a.name == "*" else a.name, message=base)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        chain = _chain(node.func)
        if chain in (["__import__"], ["importlib", "import_module"]):
            first = node.args[0] if node.args else None
            known = isinstance(first, ast.Constant) and isinstance(first.value, str)
            self._add("import", node, relation="dynamic_imports", scope=self.scope, module_name=first.value if known else None, message=ast.unparse(node)[:240])
        else:
            self._ref("calls", node, node.func)
        self.generic_visit(node)


def _own_statements(node: ast.AST) -> Iterator[ast.AST]:
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            todo += ast.iter_child_nodes(x)


def python_records(path: str, content: bytes) -> list[dict]:
    """Records of a Python file; one problem if it can't be parsed. The encoding is the one the file declares."""
    try:
        encoding = tokenize.detect_encoding(io.BytesIO(content).readline)[0]
        tree = ast.parse(content.decode(encoding))
    except (SyntaxError, UnicodeDecodeError, ValueError, LookupError, RecursionError) as e:
        return [dict.fromkeys(_NAMES) | {"record": "problem", "file": path, "language": "python", "name": "parse_error", "message": str(e)[:240], "start_line": getattr(e, "lineno", None)}]
    v = _Python(path)
    for x in tree.body:
        v.visit(x)
    defined = {(r["scope"], r["name"]) for r in v.rows if r["record"] == "binding" and r["target"]}
    # an assignment shadows nothing that the same scope defines
    return [r for r in v.rows if not (r["record"] == "binding" and r["message"] == "assigned" and (r["scope"], r["name"]) in defined)]


_CALL = r"(?:(?P<receiver>[A-Za-z_$][\w$]*)\s*(?:\.|->|::|\?\.)\s*)?(?<![\w$])(?P<name>[A-Za-z_]\w*)\s*\("
#: How far a definition reaches: its block, the rest of the file, the end of the first block after it, or, by number, the next definition of that rank or a lower one.
BLOCK, FILE, AFTER = -1, -2, -3


@dataclass(frozen=True)
class Profile:
    """How a language looks to regular expressions: group `name` of each pattern is the name, `of` what it is told with before it."""

    definitions: tuple[tuple, ...]
    imports: tuple[str, ...] = ()
    #: How blocks end; blocks that belong to a type without being one; what a type inherits; variables and their types.
    ends: Style = Style()
    owners: tuple[str, ...] = ()
    inherits: tuple[str, ...] = ()
    variables: tuple[str, ...] = ()
    calls: tuple[str, ...] = (_CALL,)
    references: tuple[str, ...] = ()
    #: Definitions whose name stands in a string; whether definitions of one name are one; what qualified names begin with and are joined by.
    told: tuple[tuple, ...] = ()
    once: bool = False
    root: str = "path"
    joint: str = "."
    #: Words that begin a command but are none, if the language is one of commands.
    commands: frozenset[str] | None = None
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    ignore: frozenset[str] = field(default=frozenset("func fn fun def if for while switch return catch sizeof function elseif match with".split()))


_N = r"(?P<name>[A-Za-z_]\w*)"
_C_TYPES = (("class", rf"\b(?:class|struct|enum|record)\s+{_N}"), ("interface", rf"\b(?:interface|trait|protocol)\s+{_N}"))
_SPLIT_TYPES = (("class", rf"\bclass\s+{_N}"), ("type", rf"\b(?:struct|enum|record)\s+(?:class\s+|struct\s+)?{_N}"), ("interface", rf"\binterface\s+{_N}"))
_INDENT = style("indent")
_RANKED = style("next")
_RUBY = style("ends", "class module def do begin case", "if unless while until for", "while until for")
_LUA = style("ends", "function do", "if while for", "while for")
_JULIA = style("ends", "module baremodule struct function begin quote do macro let try", "if for while")
_ELIXIR = style("ends", "do fn")
_MATLAB = style("ends", "", "function classdef if for while switch try parfor methods properties events enumeration")
_PASCAL = style("ends", "begin class record case try asm", folded=True)
_BASIC = style("named", "", "sub function property class module namespace structure interface enum type")
_FORTRAN = style("named", "", "program module submodule subroutine function interface")
_ADA = style("named", "", "procedure function package task protected")
_HASH = {"line_comment": "#", "block_comment": None}
PROFILES: dict[str, Profile] = {
    "c": Profile((("type", rf"\b(?:struct|enum|union)\s+{_N}\s*\{{"), ("function", rf"^[A-Za-z_][\w\s*]*?\b{_N}\s*\([^;{{}}]*\)\s*\{{")), (r"#\s*include\s*[<\"](?P<name>[^>\"]+)",)),
    "cpp": Profile((("class", rf"\b(?:class|struct)\s+{_N}[^;{{]*\{{"), ("namespace", rf"\bnamespace\s+{_N}"), ("function", rf"^[A-Za-z_][\w\s*&:<>]*?\b{_N}\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{")), (r"#\s*include\s*[<\"](?P<name>[^>\"]+)",)),
    "java": Profile((("namespace", r"^\s*package\s+(?P<name>[\w.]+)", FILE), *_SPLIT_TYPES, ("method", rf"\b(?:public|private|protected|static)\s+[\w<>\[\], ]*?\b{_N}\s*\([^;{{}}]*\)\s*[^;{{}}]*\{{")), (r"\bimport\s+(?:static\s+)?(?P<name>[\w.*]+)",)),
    "csharp": Profile((*_SPLIT_TYPES, ("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)\s*;", FILE), ("namespace", r"\bnamespace\s+(?P<name>[\w.]+)\s*\{"), ("method", rf"\b(?:public|private|protected|internal|static)\s+[\w<>\[\], ]*?\b{_N}\s*\([^;{{}}]*\)\s*\{{")), (r"\busing\s+(?:static\s+)?(?:(?P<local>\w+)\s*=\s*)?(?P<name>[\w.]+)\s*;",)),
    "go": Profile((("namespace", rf"^package\s+{_N}", FILE), ("function", rf"\bfunc\s+(?:\([^)]*\)\s*)?{_N}\s*\("), ("type", rf"\btype\s+{_N}\s+")), (r"\bimport\s+(?:\w+\s+)?\"(?P<name>[^\"]+)\"",), quotes="\"'`"),
    "rust": Profile((("function", rf"\bfn\s+{_N}"), ("type", rf"\b(?:struct|enum|type)\s+{_N}"), ("interface", rf"\btrait\s+{_N}"), ("namespace", rf"\bmod\s+{_N}")), (r"\buse\s+(?P<name>[\w:]+)",), quotes='"'),
    "php": Profile((*_C_TYPES, ("function", rf"\bfunction\s+{_N}\s*\(")), (r"\buse\s+(?P<name>[\w\\]+)",)),
    "ruby": Profile((("class", r"\bclass\s+(?P<name>[A-Z]\w*)"), ("namespace", r"\bmodule\s+(?P<name>[A-Z]\w*)"), ("method", r"\bdef\s+(?:self\.)?(?P<name>\w+[?!]?)")), (r"\brequire(?:_relative)?\s+[\"'](?P<name>[^\"']+)",), **_HASH),
    "kotlin": Profile((*_C_TYPES, ("class", rf"\bobject\s+{_N}"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_N}\s*\(")), (r"\bimport\s+(?P<name>[\w.*]+)",)),
    "swift": Profile((*_C_TYPES, ("namespace", rf"\bextension\s+{_N}"), ("method", rf"\bfunc\s+{_N}")), (r"\bimport\s+(?P<name>[\w.]+)",)),
    "dart": Profile((("class", rf"\bclass\s+{_N}"), ("function", rf"^\s*[\w<>?]+\s+{_N}\s*\([^;{{}}]*\)\s*(?:async\s*)?\{{")), (r"\bimport\s+[\"'](?P<name>[^\"']+)",)),
    "scala": Profile((("class", rf"\b(?:class|object)\s+{_N}"), ("interface", rf"\btrait\s+{_N}"), ("method", rf"\bdef\s+{_N}")), (r"\bimport\s+(?P<name>[\w.{{}}]+)",)),
    "javascript": Profile((("class", rf"\bclass\s+{_N}"), ("function", rf"\bfunction\s*\*?\s+{_N}"), ("function", rf"\b(?:const|let|var)\s+{_N}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")), (r"\bfrom\s+[\"'](?P<name>[^\"']+)", r"\brequire\(\s*[\"'](?P<name>[^\"']+)"), quotes="\"'`"),
    "typescript": Profile((("class", rf"\bclass\s+{_N}"), ("interface", rf"\binterface\s+{_N}"), ("type", rf"\btype\s+{_N}\s*="), ("function", rf"\bfunction\s*\*?\s+{_N}"), ("function", rf"\b(?:const|let)\s+{_N}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")), (r"\bfrom\s+[\"'](?P<name>[^\"']+)",), quotes="\"'`"),
    "shell": Profile((("function", rf"^\s*(?:function\s+)?{_N}\s*\(\)\s*\{{"),), (r"^\s*(?:source|\.)\s+(?P<name>\S+)",), **_HASH),
    "powershell": Profile((("function", r"\bfunction\s+(?P<name>[\w-]+)"), ("class", rf"\bclass\s+{_N}")), (r"\bImport-Module\s+(?P<name>\S+)",), line_comment="#", block_comment=("<#", "#>")),
    "lua": Profile((("function", r"\bfunction\s+(?P<name>[\w.:]+)"),), (r"\brequire\s*\(?\s*[\"'](?P<name>[^\"']+)",), line_comment="--", block_comment=("--[[", "]]")),
    "perl": Profile((("function", rf"\bsub\s+{_N}"), ("namespace", r"\bpackage\s+(?P<name>[\w:]+)", AFTER)), (r"\buse\s+(?P<name>[\w:]+)",), **_HASH),
    "julia": Profile((("function", rf"\bfunction\s+{_N}"), ("type", rf"\bstruct\s+{_N}"), ("namespace", rf"\bmodule\s+{_N}")), (r"\b(?:using|import)\s+(?P<name>[\w.]+)",), line_comment="#", block_comment=("#=", "=#"), quotes='"'),
    "elixir": Profile((("namespace", r"\bdefmodule\s+(?P<name>[\w.]+)"), ("function", r"\bdefp?\s+(?P<name>\w+[?!]?)")), (r"\b(?:import|alias|use)\s+(?P<name>[\w.]+)",), **_HASH),
    "haskell": Profile((("type", r"^(?:data|newtype|type)\s+(?P<name>[A-Z]\w*)"), ("interface", r"^class\s+(?P<name>[A-Z]\w*)"), ("function", r"^(?P<name>(?!module\b|import\b|where\b|instance\b)[a-z][\w']*)[^=\n:|]*(?:::|=(?!=))")), (r"^import\s+(?:qualified\s+)?(?P<name>[\w.]+)",), line_comment="--", block_comment=("{-", "-}"), quotes='"'),
    "groovy": Profile((("namespace", r"^\s*package\s+(?P<name>[\w.]+)", FILE), *_C_TYPES, ("function", rf"\bdef\s+{_N}\s*\(")), (r"\bimport\s+(?P<name>[\w.*]+)",)),
    "r": Profile((("function", r"(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\("),), (r"\b(?:library|require)\(\s*(?P<name>\w+)",), **_HASH),
    "vbnet": Profile((("namespace", r"(?i)\b(?:namespace|module)[ \t]+(?P<name>[\w.]+)"), ("class", rf"(?i)\b(?:class|structure)[ \t]+{_N}"), ("interface", rf"(?i)\binterface[ \t]+{_N}"), ("function", rf"(?i)\b(?:sub|function|property)[ \t]+{_N}")), (r"(?i)\bimports\s+(?P<name>[\w.]+)",), line_comment="'", block_comment=None, quotes='"'),
    "fortran": Profile((("namespace", rf"(?im)^\s*(?:module|program)\s+(?!procedure\b){_N}"), ("function", rf"(?i)\b(?:subroutine|function)[ \t]+{_N}")), (r"(?im)^\s*use\s+(?P<name>\w+)",), line_comment="!", block_comment=None),
    "pascal": Profile((("namespace", r"(?im)^\s*(?:unit|program|library)\s+(?P<name>[\w.]+)", FILE), ("function", r"(?i)\b(?:procedure|function|constructor|destructor)\s+(?:(?P<of>\w+)\.)?(?P<name>\w+)"), ("class", rf"(?i)\b{_N}\s*=\s*(?:class|record|object)\b")), (r"(?i)\buses\s+(?P<name>\w+)",), block_comment=("{", "}"), quotes="'"),
    "zig": Profile((("function", rf"\bfn\s+{_N}"), ("type", rf"\bconst\s+{_N}\s*=\s*(?:struct|enum|union)\b")), (r"@import\(\"(?P<name>[^\"]+)",), block_comment=None),
    "solidity": Profile((("class", rf"\b(?:contract|library)\s+{_N}"), ("interface", rf"\binterface\s+{_N}"), ("function", rf"\bfunction\s+{_N}")), (r"\bimport\s+[\"'](?P<name>[^\"']+)",)),
}


_MORE_N = r"(?P<name>[A-Za-z_][\w.]*)"
PROFILES |= {
    "erlang": Profile((("function", r"^(?P<name>[a-z]\w*)\s*\([^)]*\)\s*(?:when[^>]*)?->"), ("namespace", r"^-module\(\s*(?P<name>\w+)", FILE)), (r"^-(?:import|include(?:_lib)?)\(\s*\"?(?P<name>[\w./]+)",), ends=_INDENT, line_comment="%", block_comment=None),
    "ocaml": Profile((("function", rf"^\s*let\s+(?:rec\s+)?{_N}"), ("type", rf"^\s*type\s+{_N}"), ("namespace", r"^\s*module\s+(?P<name>[A-Z]\w*)")), (r"^\s*open\s+(?P<name>[\w.]+)",), ends=_INDENT, line_comment="", block_comment=("(*", "*)"), quotes='"'),
    "fsharp": Profile((("function", rf"^\s*let\s+(?:rec\s+|inline\s+)?{_N}"), ("type", rf"^\s*type\s+{_N}"), ("namespace", r"^(?:module|namespace)\s+(?P<name>[\w.]+)\s*$", FILE), ("namespace", r"^\s*module\s+(?P<name>[\w.]+)\s*="), ("method", rf"^\s*member\s+\w+\.{_N}")), (r"^\s*open\s+(?P<name>[\w.]+)",), ends=_INDENT, block_comment=("(*", "*)"), quotes='"'),
    "clojure": Profile((("function", r"\(defn-?\s+(?P<name>[^\s\[\]()]+)"), ("namespace", r"\(ns\s+(?P<name>[\w.-]+)"), ("type", r"\(def(?:record|type|protocol)\s+(?P<name>\w+)")), (r"\(:?require\s+'?\[?(?P<name>[\w.-]+)",), ends=_INDENT, line_comment=";", block_comment=None, quotes='"'),
    "nim": Profile((("function", rf"^\s*(?:proc|func|method|template|macro|iterator)\s+{_N}"), ("type", rf"^\s+{_N}\*?\s*=\s*(?:ref\s+)?object\b")), (r"^\s*(?:import|include|from)\s+(?P<name>[\w/.]+)",), ends=_INDENT, **_HASH),
    "ada": Profile((("function", r"(?i)\b(?:procedure|function)\s+(?P<name>\w+)"), ("namespace", r"(?i)\bpackage\s+(?:body\s+)?(?P<name>[\w.]+)"), ("type", rf"(?i)\btype\s+{_N}")), (r"(?i)^\s*with\s+(?P<name>[\w.]+)",), ends=_ADA, line_comment="--", block_comment=None, quotes='"'),
    "objectivec": Profile((("class", rf"@(?:interface|implementation)\s+{_N}", "@end"), ("interface", rf"@protocol\s+{_N}(?!\s*[;,])", "@end"), ("method", r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)"), ("function", rf"^[A-Za-z_][\w\s*]*?\b{_N}\s*\([^;{{}}]*\)\s*\{{")), (r"#\s*(?:import|include)\s*[<\"](?P<name>[^>\"]+)",), inherits=(r"@interface\s+(?P<name>\w+)\s*:\s*(?P<bases>\w+)",), calls=(_CALL, r"\[\s*(?P<receiver>\w+)\s+(?P<name>\w+)"), once=True),
    "vba": Profile((("method", r"(?im)^\s*(?:public\s+|private\s+)?(?:sub|function|property\s+\w+)\s+(?P<name>\w+)"), ("type", rf"(?im)^\s*(?:public\s+|private\s+)?type\s+{_N}")), (), told=(("namespace", r"(?im)^attribute\s+vb_name\s*=\s*\"(?P<name>\w+)\"", FILE),), ends=_BASIC, line_comment="'", block_comment=None, quotes='"'),
    "matlab": Profile((("function", r"^\s*function\s+(?:\[?[\w,\s]*\]?\s*=\s*)?(?P<name>\w+)"), ("class", rf"^\s*classdef\s+{_N}")), (r"^\s*import\s+(?P<name>[\w.*]+)",), ends=_MATLAB, line_comment="%", block_comment=("%{", "%}"), inherits=(r"classdef\s+(?P<name>\w+)\s*<\s*(?P<bases>[\w &]+)",)),
    "cobol": Profile((("namespace", r"(?im)^[ \d]*program-id\.\s+(?P<name>[\w-]+)", 0), ("namespace", r"(?im)^[ \d]{0,10}(?P<name>[A-Z][\w-]*)\s+section\s*\.", 1), ("function", r"(?im)^(?:[ \d]{6} {1,4})?(?P<name>[A-Z][\w-]*)\s*\.[ \t]*$", 2)), (r"(?im)^\s*copy\s+(?P<name>[\w-]+)",), calls=(r"(?i)\bperform\s+(?P<name>(?!until\b|varying\b|with\b)[A-Z][\w-]*)",), ends=_RANKED, line_comment="*>", block_comment=None),
    "assembly": Profile((("function", r"^(?P<name>[A-Za-z_.][\w.$]*):", 0),), (r"^\s*[.%]?include\s+[\"<]?(?P<name>[\w./]+)",), calls=(r"(?i)^\s+(?:call|bl|blx|jal|jsr)\s+(?P<name>[A-Z_.][\w.$]*)",), ends=_RANKED, line_comment=";", block_comment=None),
    "hcl": Profile((("type", r"^(?:resource|data)\s+\"(?P<of>[^\"]+)\"\s+\"(?P<name>[^\"]+)\""), ("type", r"^(?:variable|output|module|provider)\s+\"(?P<name>[^\"]+)\"")), (r"^\s*source\s*=\s*\"(?P<name>[^\"]+)",), calls=(), references=(r"\b(?:var|module|local)\.(?P<name>\w+)", r"(?<![\w.])(?:data\.)?(?!var\.|module\.|local\.|data\.|each\.|path\.)(?P<of>[a-z]\w*)\.(?P<name>\w+)"), line_comment="#", block_comment=("/*", "*/"), quotes=""),
    "gdscript": Profile((("class", rf"^class_name\s+{_N}", FILE), ("class", rf"^class\s+{_N}"), ("function", rf"^\s*(?:static\s+)?func\s+{_N}")), (r"\b(?:preload|load)\(\s*\"(?P<name>[^\"]+)",), ends=_INDENT, inherits=(r"^class\s+(?P<name>\w+)\s+extends\s+(?P<bases>\w+)",), **_HASH),
}
PROFILES["cuda"] = PROFILES["cpp"]
_EXTENDS = r"\b(?:class|struct|interface|record|object|trait)\s+(?P<name>[A-Za-z_]\w*)(?:<[^{>]*>)?[^{:;]*?"
_TYPED = r"\b(?P<type>[A-Z]\w*)(?:<[^;=(){}]*>)?(?:\[\])?\s+(?P<name>[a-z_]\w*)\s*(?=[=;,):])"
_LABELLED = r"\b(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[A-Z]\w*)"
_MADE = r"\b(?:val|var|let|const)\s+(?P<name>[a-z_]\w*)\s*=\s*(?:new\s+)?(?P<type>[A-Z]\w*)\s*[({]"
#: What the profiles of languages with classes add: what types inherit, which blocks belong to a type, what variables hold.
_CLASSES = {
    "java": {"root": "package", "inherits": (_EXTENDS + r"\bextends\s+(?P<bases>[\w.,<> ]+?)(?=\s*(?:implements|permits|\{))", r"\b(?:class|record|enum)\s+(?P<name>\w+)[^{;]*?\bimplements\s+(?P<bases>[\w.,<> ]+?)(?=\s*(?:permits|\{))"), "variables": (_TYPED,)},
    "csharp": {"root": "package", "inherits": (r"\b(?:class|struct|interface|record)\s+(?P<name>\w+)(?:<[^{>]*>)?\s*:\s*(?P<bases>[\w.,<> ]+)",), "variables": (_TYPED,)},
    "kotlin": {"inherits": (r"\b(?:class|interface|object)\s+(?P<name>\w+)(?:<[^{>]*>)?(?:\([^)]*\))?\s*:\s*(?P<bases>[\w.,<>() ]+)",), "variables": (_LABELLED, _MADE)},
    "swift": {"inherits": (r"\b(?:class|struct|protocol|enum|extension)\s+(?P<name>\w+)(?:<[^{>]*>)?\s*:\s*(?P<bases>[\w.,<> ]+)",), "variables": (_LABELLED, _MADE)},
    "php": {"inherits": (_EXTENDS + r"\bextends\s+(?P<bases>[\w\\\\, ]+?)(?=\s*(?:implements|\{))", r"\bclass\s+(?P<name>\w+)[^{;]*?\bimplements\s+(?P<bases>[\w\\\\, ]+?)(?=\s*\{)"), "variables": (r"\$(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)", r"\b(?P<type>[A-Z]\w*)\s+\$(?P<name>\w+)")},
    "scala": {"inherits": (_EXTENDS + r"\bextends\s+(?P<bases>[\w.]+(?:\s+with\s+[\w.]+)*)",), "variables": (_LABELLED, _MADE)},
    "dart": {"inherits": (r"\bclass\s+(?P<name>\w+)[^{;]*?\b(?:extends|implements|with)\s+(?P<bases>[\w.,<> ]+?)(?=\s*(?:implements|with|\{))",), "variables": (_TYPED,)},
    "javascript": {"inherits": (r"\bclass\s+(?P<name>\w+)\s+extends\s+(?P<bases>[\w.]+)",), "variables": (_MADE,)},
    "typescript": {"inherits": (r"\b(?:class|interface)\s+(?P<name>\w+)(?:<[^{>]*>)?\s+(?:extends|implements)\s+(?P<bases>[\w., ]+?)(?=\s*(?:implements|\{))",), "variables": (_LABELLED, _MADE)},
    "cpp": {"inherits": (r"\b(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?:\s*(?P<bases>[\w:,<> ]+)",)},
    "ruby": {"inherits": (r"\bclass\s+(?P<name>\w+)\s*<\s*(?P<bases>[\w:]+)",), "variables": (r"\b(?P<name>[a-z_]\w*)\s*=\s*(?P<type>[A-Z]\w*)\.new\b",), "ends": _RUBY},
    "go": {"root": "package", "variables": (r"\b(?P<name>[a-z_]\w*)\s*:?=\s*&?(?P<type>[A-Z]\w*)\{", r"\b(?P<name>[a-z_]\w*)\s+\*?(?P<type>[A-Z]\w*)\s*(?=[,)])")},
    "rust": {"root": "crate", "joint": "::", "owners": (r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>[A-Za-z_]\w*)",), "inherits": (r"\btrait\s+(?P<name>\w+)\s*:\s*(?P<bases>[\w:+ ]+)", r"\bimpl(?:<[^>]*>)?\s+(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<name>\w+)"), "variables": (r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)\s*(?:::|\{)", r"\b(?P<name>[a-z_]\w*)\s*:\s*&?(?:mut\s+)?(?P<type>[A-Z]\w*)")},
    "powershell": {"inherits": (r"\bclass\s+(?P<name>\w+)\s*:\s*(?P<bases>\w+)",), "commands": frozenset("if else elseif for foreach while do switch return function class param begin process end try catch finally throw break continue in Import-Module using".split())},
    "shell": {"calls": (), "commands": frozenset("fi for done case esac in function select local declare typeset readonly export return exit break continue set unset shift trap eval test true false [ [[ ! : . source".split())},
    "julia": {"ends": _JULIA}, "elixir": {"ends": _ELIXIR, "once": True}, "haskell": {"ends": _INDENT, "once": True}, "lua": {"ends": _LUA}, "erlang": {"once": True}, "r": {"ends": Style(lines=True)},
    "vbnet": {"ends": _BASIC, "inherits": (r"(?i)\bclass\s+(?P<name>\w+)\s+inherits\s+(?P<bases>\w+)",)},
    "fortran": {"ends": _FORTRAN}, "pascal": {"ends": _PASCAL, "calls": (_CALL, r"(?i)(?:;|\b(?:begin|then|else|do|repeat)\b)\s*(?P<name>(?!begin\b|end\b|exit\b|until\b)[a-z_]\w*)\s*(?=;|\bend\b)")},
}
PROFILES |= {k: replace(PROFILES[k], **v) for k, v in _CLASSES.items()}
#: Of JavaScript and TypeScript, methods inside classes too.
_JS_METHOD = ("method", r"^\s+(?:static\s+|async\s+|public\s+|private\s+|protected\s+)*(?P<name>[A-Za-z_$]\w*)\s*\([^;{}()]*\)\s*(?::[^={;]+)?\{")
PROFILES |= {k: replace(PROFILES[k], definitions=(*PROFILES[k].definitions, _JS_METHOD)) for k in ("javascript", "typescript")}
_NO_TYPE = r"(?!(?:return|throw|new|else|await|yield|using|case|import|do|try)\b)"
_JAVA_METHOD = ("method", r"(?:^|[{};])\s*(?:@\w+\s+)*" + _NO_TYPE + r"(?:[\w<>\[\], .?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:throws\s+[\w., ]+)?\{")
PROFILES |= {k: replace(PROFILES[k], definitions=(*PROFILES[k].definitions, _JAVA_METHOD)) for k in ("java", "csharp", "dart")}
_JAVA_DECLARED = ("method", r"(?:^|[{};])\s*" + _NO_TYPE + r"(?:[\w<>\[\],.?]+\s+)+(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:throws\s+[\w., ]+)?;")
PROFILES |= {k: replace(PROFILES[k], definitions=(*PROFILES[k].definitions, _JAVA_DECLARED)) for k in ("java", "csharp")}


def masked(text: str, p: Profile) -> str:
    """text with comments and the insides of strings as spaces; line breaks and offsets stay."""
    parts = [re.escape(p.line_comment) + r"[^\n]*"] if p.line_comment else []
    if p.block_comment:
        a, b = map(re.escape, p.block_comment)
        parts.insert(0, rf"{a}[\s\S]*?(?:{b}|\Z)")
    if not p.quotes:
        return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.M) if parts else text
    strings = "|".join(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*(?:{q}|$)" if q != "`" else r"`[^`]*(?:`|\Z)" for q in p.quotes)

    def blank(m: re.Match) -> str:
        s = m[0]
        if s[0] in p.quotes and m.lastgroup == "s" and len(s) > 1 and s[-1] == s[0]:
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[0]
        return re.sub(r"[^\n]", " ", s)

    return re.sub("|".join([*parts, f"(?P<s>{strings})"]), blank, text, flags=re.M)


@dataclass
class _Definition:
    kind: str
    name: str
    before: str | None  # what the name is told with
    at: int
    end: int  # of the name
    reach: int | str
    head: int = 0
    params: int = 0  # where they are looked for
    stop: int = 0
    id: str | None = None  # none for a block that only belongs to a type
    arity: int | None = None
    around: list[_Definition] = field(default_factory=list)

    @property
    def shown(self) -> str:
        return self.name if self.before is None else f"{self.before}.{self.name}"

    @property
    def owns(self) -> bool:
        return self.kind in _TYPES or self.kind == "owner"


def _definitions(code: str, text: str, p: Profile) -> list[_Definition]:
    """Definitions and blocks of types in the order of their names' places."""
    found: dict[int, _Definition] = {}
    for where, entries in ((code, p.definitions), (text, p.told), (code, [("owner", x) for x in p.owners])):
        for kind, pattern, *reach in entries:
            for m in re.finditer(pattern, where, re.M):
                s, name = m.start("name"), m["name"]
                closing = re.search(r"(?i)\b(?:end|exit)[ \t]+(?:\w+[ \t]+)?$", code[max(0, s - 40) : s])
                hidden = entries is p.told and code[m.start()].isspace()  # in a comment
                if name not in p.ignore and name not in _WORDS and not closing and not hidden:
                    found.setdefault(s, _Definition(kind, name, m.groupdict().get("of"), s, m.end("name"), reach[0] if reach else BLOCK, m.start(), m.end() - 1 if m[0].endswith("(") else m.end("name")))
    return [found[k] for k in sorted(found)]


def _reaches(found: list[_Definition], code: str, blocks: Blocks, lang: str) -> None:
    """Sets where each definition stops, and its number of parameters."""
    for k, d in enumerate(found):
        arity, after = _arguments(code, d.params)
        if d.kind in ("function", "method"):
            own = lang == "rust" and re.match(r"[^(]*\(\s*&?(?:'\w+\s+)?(?:mut\s+)?self\b", code[d.end : after]) is not None  # a call doesn't name it
            d.arity = arity - own
        head = max(d.end, after)
        if d.reach == FILE:
            d.stop = len(code)
        elif d.reach == AFTER:
            first = next((x for x in blocks.opens if x >= head), None)
            d.stop = len(code) if first is None else blocks.close.get(first, len(code))
        elif isinstance(d.reach, str):
            end = code.find(d.reach, head)
            d.stop = len(code) if end < 0 else end + len(d.reach)
        elif d.reach >= 0:
            d.stop = next((x.head for x in found[k + 1 :] if isinstance(x.reach, int) and 0 <= x.reach <= d.reach), len(code))
        else:
            d.stop = blocks.end(d.at, head)


_SEEN = re.compile(r"\b(?:public|private|protected|internal|fileprivate|open|static|pub|export)\b")


def profile_records(path: str, content: bytes, lang: str) -> list[dict]:
    """Records of a file by its language's profile; matches that begin in a comment or string don't count."""
    p, text = PROFILES[lang], content.decode("utf-8", "replace")
    code = masked(text, p)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(start: int, end: int) -> dict:
        a, b = bisect_right(lines, start) - 1, bisect_right(lines, end) - 1
        return {"start": start, "start_line": a + 1, "start_col": len(text[lines[a] : start].encode()), "end_line": b + 1, "end_col": len(text[lines[b] : end].encode())}

    new = lambda record, **v: dict.fromkeys(_NAMES) | {"record": record, "file": path, "language": lang} | v
    module = f"{lang}:{path}:module"
    rows = [new("node", id=module, kind="module", name=path.rsplit("/", 1)[-1], qualified_name=path)]
    found = _definitions(code, text, p)
    _reaches(found, code, Blocks(code, p.ends), lang)
    root = {"path": path, "crate": _crate(path)}.get(p.root, "")
    types = {d.name: d for d in reversed(found) if d.kind in _TYPES}
    used: dict[str, int] = {}
    of_name: dict[str, str] = {}
    open_: list[_Definition] = []
    for d in found:
        open_ = [x for x in open_ if d.at < x.stop]
        d.around = list(open_)
        if lang == "go" and d.kind == "function" and (receiver := _go_receiver(code, d.at)):
            d.around.append(_Definition("owner", receiver, None, d.at, d.end, BLOCK, stop=d.stop))
            d.head = code.rfind("\n", 0, d.at) + 1  # the receiver stands before the name
        apart = None
        if d.before in types and types[d.before] is not d:
            apart, d.before = types[d.before], None
            d.around = [*apart.around, apart]
        open_.append(d)
        if d.kind == "owner":
            continue
        owner = next((x for x in reversed(d.around) if x.owns), None)
        if d.kind == "function" and owner is not None and not (p.joint == "::" and owner.kind == "namespace"):
            d.kind = "method"
        shown = d.shown
        if p.root != "path" and d.arity is not None:
            made = lang in ("java", "csharp") and owner is not None and d.name == owner.name
            shown = f"{'<init>' if made else shown}({d.arity})"
        chain: list[str] = []
        for x in [*d.around, d]:
            told = shown if x is d else x.shown
            # a block of a type in a package is the type's own
            chain += [told] if x.kind != "owner" or not chain or chain[-1] != told else []
        qualified = p.joint.join(x for x in (root, *chain) if x)
        base = f"{lang}:{path}:{p.joint.join(chain)}:{d.kind}"
        if p.once and base in of_name:
            d.id = base
            continue
        k = used[base] = used.get(base, -1) + 1
        d.id = base if not k else f"{base}~{d.at}"
        of_name[base] = d.id
        holder = next((x for x in reversed(d.around if apart is None else apart.around) if x.id or x.kind == "owner"), None)
        parent = module if holder is None else holder.id or (types[holder.name].id if holder.name in types else None)
        if parent is None:
            parent = f"?{holder.name}"
        seen = " ".join(_SEEN.findall(code[max(code.rfind(c, 0, d.at) for c in "\n;{}") + 1 : d.at]))
        rows += [
            new("node", id=d.id, kind=d.kind, name=d.name, qualified_name=qualified, parent_id=parent, arity=d.arity, owner=owner.name if owner else None, message=seen or None,
                return_behavior=returns(code[d.end : d.stop]) if d.kind in ("function", "method") else None, **at(d.at, d.end)),
            *(new("binding", scope=module, name=n, target=d.id, start=d.at) for n in dict.fromkeys((d.name, d.shown))),
        ]
    for r in rows:
        if r["record"] == "node" and (r["parent_id"] or "").startswith("?"):  # a block of a type that comes later, or from another file
            t = types.get(r["parent_id"][1:])
            r["parent_id"] = t.id if t is not None and t.id else module
    begins = sorted(found, key=lambda d: (d.head if lang == "go" else d.at, -d.stop))
    starts = [d.head if lang == "go" else d.at for d in begins]

    def inside(offset: int) -> tuple[str, str | None]:
        """The definition around an offset, and the type it belongs to."""
        scope, owner = module, None
        for d in reversed(begins[: bisect_right(starts, offset)]):
            if offset < d.stop:
                if scope == module and d.id:
                    scope, outer = d.id, [x.name for x in d.around if x.owns]
                    owner = owner or (outer[-1] if outer and not d.owns else None)
                owner = owner or (d.name if d.owns else None)
                if scope != module and owner is not None:
                    break
        return scope, owner

    for pattern in p.imports:
        for m in re.finditer(pattern, text, re.M):
            if code[m.start()] == text[m.start()] and not code[m.start()].isspace():
                rows.append(new("import", relation="imports", scope=module, name=m["name"], module_name=m["name"], message=m["name"], receiver=m.groupdict().get("local"), **at(m.start(), m.end())))
    for pattern in p.inherits:
        for m in re.finditer(pattern, code, re.M):
            for base in re.split(r"\s*(?:,|&|\+|\bwith\b)\s*", re.sub(r"<[^<>]*>|\([^()]*\)", "", m["bases"])):
                base = re.split(r"\.|::|\\\\", re.sub(r"^(?:public|private|protected|virtual)\s+", "", base.strip()).strip())[-1]
                if base and m["name"] in types:
                    rows.append(new("ref", relation="inherits", scope=types[m["name"]].id, chain=[base], message=base, owner=m["name"], **at(m.start("bases"), m.end("bases"))))
    for pattern in p.variables:
        for m in re.finditer(pattern, code, re.M):
            if m["type"] not in _WORDS and m["name"] not in _WORDS:
                scope, owner = inside(m.start())
                rows.append(new("variable", scope=scope, name=m["name"], target=m["type"], owner=owner, start=m.start()))
                if p.root != "path":
                    rows.append(new("ref", relation="uses", scope=scope, chain=[m["type"]], message=m["type"], owner=owner, **at(m.start("type"), m.end("type"))))
    names = {d.at for d in found}
    for start, end, name, pipeline in _commands(code, p) if p.commands is not None else ():
        if start not in names and not (m := re.match(r"\s*\(\)", code[end:])):
            rows.append(new("command", scope=inside(start)[0], name=name, message=name, arity=pipeline, **at(start, end)))
    for relation, patterns in (("calls", p.calls), ("references", p.references)):
        for pattern in patterns:
            for m in re.finditer(pattern, code, re.M):
                name = m["name"]
                if name in p.ignore or name in _WORDS or m.start("name") in names:
                    continue
                scope, owner = inside(m.start("name"))
                said = m.groupdict()
                receiver = (said.get("receiver") or "").lstrip("$") or None
                name = f"{said['of']}.{name}" if said.get("of") else name
                if scope != module or relation == "calls":
                    rows.append(new("ref", relation=relation, scope=scope, chain=[name], message=f"{said['receiver']}.{name}" if receiver else name, owner=owner, receiver=receiver, arity=_arguments(code, m.end("name"))[0], **at(m.start("name"), m.end("name"))))
    return rows


_STEP = re.compile(r"\|\||&&|\|&?|[;&\n(){}]|\$\(|`")
#: Words before a command that leave it one.
_LEADS = frozenset("if then elif else while until do time exec coproc !".split())


def _commands(code: str, p: Profile) -> Iterator[tuple[int, int, str, int | None]]:
    """(start, end, name, start of its pipeline or null) of the simple commands of masked code: the first word of each that is no assignment, redirection or reserved word."""
    at, depth, steps = 0, 0, []
    for m in [*_STEP.finditer(code), None]:
        mark = m[0] if m else "\n"
        case = mark == ")" and not depth  # what stands before it is a pattern
        depth += (mark in ("(", "$(")) - (mark == ")" and depth > 0)
        for w in re.finditer(r"\S+", code[at : m.start() if m else len(code)]):
            word = w[0]
            if word in _LEADS or re.match(r"[A-Za-z_]\w*\+?=|\d*[<>]", word):
                continue
            if word not in p.commands and not case and re.fullmatch(r"[A-Za-z_./][\w./:+-]*", word):
                steps.append((at + w.start(), at + w.end(), word))
            break
        if mark not in ("|", "|&") or case:
            steps = [] if case else steps
            yield from ((x, y, word, steps[0][0] if len(steps) > 1 else None) for x, y, word in steps)
            steps = []
        at = m.end() if m else at


def _crate(path: str) -> str:
    """The path of a Rust file's module: src/a/b.rs is crate::a::b, and lib, main and mod name their folder."""
    parts = re.sub(r"\.rs$", "", path).split("/")
    parts = parts[len(parts) - parts[::-1].index("src") :] if "src" in parts else parts
    return "::".join(["crate", *(parts[:-1] if parts[-1] in ("lib", "main", "mod") else parts)])


_TYPES = frozenset(["class", "interface", "type", "namespace"])
_WORDS = frozenset("func fn fun def if for while switch return catch sizeof function elseif match with new throw else do in of typeof await yield import super this self using lock foreach try synchronized".split())


def _arguments(code: str, after: int) -> tuple[int, int]:
    """(number of arguments, where they end) of the brackets that open after an offset; none without brackets."""
    m = re.compile(r"\s*(?:<[^<>()]*>\s*)?\(").match(code, after)
    if not m:
        return 0, after
    depth, commas, some = 1, 0, False
    for k in range(m.end(), len(code)):
        c = code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return commas + 1 if some else 0, k + 1
        elif c == "," and depth == 1:
            commas += 1
        some = some or not c.isspace()
    return commas + 1 if some else 0, len(code)


def _go_receiver(code: str, at: int) -> str | None:
    """The type that a Go method is declared on."""
    m = re.search(r"\bfunc\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^()]*\)\s*$", code[max(0, at - 200) : at])
    return m[1] if m else None


#: Records that are given out together.
_TOGETHER = 4096


def records(files: DataFrame) -> DataFrame:
    """Records of files of (path, language, content); a file that can't be read gives a problem, not a failure."""

    def table(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_NAMES)
        for c in ("start", "start_line", "start_col", "end_line", "end_col", "arity"):
            out[c] = out[c].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for b in batches:
            for path, lang, content in zip(b["path"], b["language"], b["content"], strict=True):
                held += python_records(path, bytes(content or b"")) if lang == "python" else profile_records(path, bytes(content or b""), lang) if lang in PROFILES else [dict.fromkeys(_NAMES) | {"record": "problem", "file": path, "language": lang, "name": "parser_unavailable", "message": lang}]
                if len(held) >= _TOGETHER:  # a table for each file takes longer than reading it
                    yield table(held)
                    held = []
        if held:
            yield table(held)

    return files.select("path", "language", "content").mapInPandas(run, RECORDS)
