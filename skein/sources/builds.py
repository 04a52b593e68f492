"""What a build knows of sources: Go and Rust conditions, compile commands, types on a class path, module names."""

from __future__ import annotations

import io
import os
import re
import shlex
import tomllib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of Go's systems and processors in tags and file names, and systems that are no unix.
GO_SYSTEMS = frozenset("aix android darwin dragonfly freebsd hurd illumos ios js linux netbsd openbsd plan9 solaris wasip1 windows".split())
GO_PROCESSORS = frozenset("386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x wasm".split())
GO_NOT_UNIX = frozenset("android ios js wasip1 windows".split())


@dataclass(frozen=True)
class GoBuild:
    tags: tuple[str, ...] = ()
    system: str | None = None
    processor: str | None = None

    def values(self) -> frozenset[str]:
        unix = {"unix"} if self.system in GO_SYSTEMS - GO_NOT_UNIX else set()
        return frozenset({*self.tags, *filter(None, (self.system, self.processor)), *unix})


def go_condition(expression: str, true: frozenset[str]) -> bool | None:
    """The value of a //go:build expression; None if it is none. Names become True or False, and Python reads the rest."""
    parts = re.findall(r"&&|\|\||[!()]|[\w./-]+|\S", expression)
    words = {"&&": "and", "||": "or", "!": "not", "(": "(", ")": ")"}
    code = " ".join(words.get(p) or str(p in true) for p in parts)
    if not parts or any(p not in words and not re.fullmatch(r"[\w./-]+", p) for p in parts):
        return None
    try:
        return bool(eval(compile(code, "<condition>", "eval"), {"__builtins__": {}}))  # noqa: S307 - only True, False, and, or, not and brackets
    except (SyntaxError, TypeError, RecursionError, MemoryError):
        return None


def go_takes(path: str, text: str, build: GoBuild) -> bool:
    """Whether a Go file belongs to the build. Without any setting all files do, and so does what can't be read."""
    if not (build.tags or build.system or build.processor):
        return True
    parts = os.path.splitext(os.path.basename(path))[0].split("_")
    for names, own in ((GO_SYSTEMS, build.system), (GO_PROCESSORS, build.processor)):
        if own and any(p in names and p != own for p in parts):
            return False
    true = build.values()
    lines = [x.strip() for x in text.splitlines()]
    if modern := [x.removeprefix("//go:build").strip() for x in lines if x.startswith("//go:build")]:
        return all(go_condition(x, true) is not False for x in modern)
    holds = lambda tag: (tag[1:] not in true) if tag.startswith("!") else tag in true
    old = [x.removeprefix("// +build").split() for x in lines if x.startswith("// +build")]
    return all(any(all(map(holds, group.split(","))) for group in line) for line in old)


@dataclass(frozen=True)
class RustBuild:
    features: tuple[str, ...] = ()
    target: str | None = None
    all_cfg: bool = True


_TARGET_KEYS = frozenset("target_arch target_endian target_env target_family target_feature target_os target_pointer_width target_vendor unix windows".split())
_SYSTEMS = ("windows", "linux", "darwin", "macos", "freebsd", "openbsd", "netbsd", "android", "ios")


def _rust_facts(build: RustBuild) -> set[str]:
    parts = (build.target or "").split("-")
    facts = {f"target_arch={parts[0]}"} if parts[0] else set()
    if system := next((s for s in _SYSTEMS if s in parts), None):
        family = system if system in ("windows", "android", "ios") else "unix"
        facts |= {system, f"target_os={system}", f"target_family={family}", family}
    return facts


def rust_condition(expression: str, build: RustBuild) -> bool:
    """Whether code under #[cfg(expression)] is in the build; what can't be known counts as in it.

    Atoms become T, F or U (unknown); the innermost all, any or not is replaced by its value until one letter is left.
    """
    if build.all_cfg:
        return True
    facts = _rust_facts(build)

    def atom(m: re.Match) -> str:
        name, value = m["name"], m["value"]
        if value is not None:
            if name == "feature":
                return "T" if value in build.features else "F"
            known = name in _TARGET_KEYS or name.startswith("target_")
            return "U" if not known or build.target is None else "T" if f"{name}={value}" in facts else "F"
        if name in ("true", "all_cfg", "false"):
            return "F" if name == "false" else "T"
        if name in _TARGET_KEYS:
            return "U" if build.target is None else "T" if name in facts else "F"
        return "T" if name in build.features else "U"

    def call(m: re.Match) -> str:
        has = [x for x in re.split(r"[\s,]+", m[2]) if x]
        if m[1] == "not":
            return {"T": "F", "F": "T"}.get(has[0], "U") if len(has) == 1 else "U"
        decides, other = ("F", "T") if m[1] == "all" else ("T", "F")
        return decides if decides in has else "U" if "U" in has else other

    left = re.sub(r'(?P<name>[A-Za-z_][\w.-]*)(?!\s*\()(?![\w.-])\s*(?:=\s*"(?P<value>[^"]*)")?', atom, expression)
    while (new := re.sub(r"\b(all|any|not)\s*\(\s*((?:[TFU]\s*,?\s*)*)\)", call, left)) != left:
        left = new
    return left.strip() != "F"


def in_build(path: Column, text: Column, go: GoBuild) -> Column:
    """go_takes() over a table of files; only .go files pass through Python."""

    @F.pandas_udf(T.BooleanType())
    def takes(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([go_takes(p, t or "", go) for p, t in zip(paths, texts, strict=True)], dtype=object)

    return F.when(path.endswith(".go"), takes(path, text)).otherwise(True)


def go_module(text: str) -> str | None:
    m = re.search(r"(?m)^\s*module\s+(\S+)\s*$", text)
    return m[1] if m else None


def crate_name(text: str, folder: str) -> str:
    """The crate's name in a Cargo.toml, or that of its folder; a dash reads as an underscore."""
    try:
        name = tomllib.loads(text).get("package", {}).get("name")
    except (tomllib.TOMLDecodeError, AttributeError):
        name = None
    name = name.strip() if isinstance(name, str) else ""
    return (name or os.path.basename(folder.rstrip("/"))).replace("-", "_") or "crate"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(commands: pd.Series) -> pd.Series:
    def split(c: str | None) -> list[str] | None:
        try:
            return None if c is None else shlex.split(c)
        except ValueError:
            return c.split()

    return commands.map(split)


def _flagged(args: Column, *flags: str) -> Column:
    """Values of flags in an argument list, whether joined to the flag or next to it."""

    def value(a: Column, i: Column) -> Column:
        out = F.when(a.isin(*flags), F.get(args, i + 1))
        for f in flags:
            out = out.when(a.startswith(f), F.substring(a, len(f) + 1, 100_000))
        return F.trim(out, F.lit('"'))

    return F.filter(F.transform(args, value), lambda x: x.isNotNull() & (x != ""))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, include_dirs, defines, standard) of a compilation database; entries without a file or a command don't count."""
    entry = "array<struct<file:string,directory:string,command:string,arguments:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("e")).select("e.*")
    args = F.coalesce("arguments", _words("command"))
    rows = rows.withColumn("args", args).where("file is not null and size(args) > 0").withColumn("directory", F.coalesce("directory", F.lit(".")))
    under = lambda p: F.when(p.rlike(r"^(/|[A-Za-z]:)"), p).otherwise(F.concat("directory", F.lit("/"), p))
    return rows.select(
        under(F.col("file")).alias("file"), "directory", F.transform(_flagged(F.col("args"), "-I", "/I", "-isystem"), under).alias("include_dirs"),
        _flagged(F.col("args"), "-D", "/D").alias("defines"), F.get(_flagged(F.col("args"), "-std=", "/std:"), F.lit(0)).alias("standard"),
    )


#: Bytes of an archive, of a source in it, and of all its sources that are read.
ARCHIVE, SOURCE, SOURCES = 256 << 20, 8 << 20, 64 << 20
_PACKAGE = re.compile(r"(?m)^\s*(?:package|namespace)\s+([\w.]+)")
_TYPE = re.compile(r"\b(?:class|interface|enum|record|struct|object|trait)\s+([A-Za-z_]\w*)")
_METHOD = re.compile(r"\b([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:[\w\s,:<>?]*)\{")
_NO_METHODS = frozenset("if for while switch catch return synchronized when using lock".split())


def _source_types(text: str, hint: str | None) -> Iterator[tuple[str, str | None]]:
    m = _PACKAGE.search(text)
    package = m[1] if m else hint
    methods = [x for x in _METHOD.findall(text) if x not in _NO_METHODS]
    for name in _TYPE.findall(text):
        whole = f"{package}.{name}" if package else name
        yield whole, None
        yield from ((whole, x) for x in methods)


def _entry_types(path: str, content: bytes, suffixes: tuple[str, ...], root: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(type, method, problem) of a class path's file: an archive, a source, or a class."""
    low = path.lower()
    if low.endswith((".jar", ".zip")):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                held = 0
                for info in z.infolist():
                    name = info.filename
                    if name.endswith("/"):
                        continue
                    if name.startswith("/") or "\\" in name or {"", ".", ".."} & set(name.split("/")):
                        yield "", None, f"unsafe member: {name}"
                    elif name.endswith(".class"):
                        if not name.endswith("module-info.class"):
                            yield name[:-6].replace("/", "."), None, None
                    elif name.lower().endswith(suffixes):
                        if info.file_size > SOURCE or held + info.file_size > SOURCES:
                            yield "", None, f"source too large: {name}"
                            continue
                        held += info.file_size
                        for t, m in _source_types(z.read(info).decode("utf-8", "replace"), ".".join(name.split("/")[:-1]) or None):
                            yield t, m, None
        except (zipfile.BadZipFile, RuntimeError, KeyError, OSError) as e:
            yield "", None, f"unreadable archive: {e}"
    elif low.endswith(".class"):
        yield os.path.relpath(path, root)[:-6].replace(os.sep, "."), None, None
    elif low.endswith(suffixes):
        for t, m in _source_types(content.decode("utf-8", "replace"), None):
            yield t, m, None


def type_index(spark: SparkSession, paths: list[str], language: str = "java") -> DataFrame:
    """(type, method, path, problem): types that archives, folders and sources of a class path hold; method is null for a type itself."""
    suffixes = {"csharp": (".cs",)}.get(language, (".java", ".kt", ".kts"))
    schema = "type string, method string, path string, problem string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, length, content, root in zip(b["path"], b["length"], b["content"], b["root"], strict=True):
                local = path.removeprefix("file:")
                found = [("", None, "archive too large")] if length > ARCHIVE else list(_entry_types(local, bytes(content), suffixes, root))
                yield pd.DataFrame([(t or None, m, path, p) for t, m, p in found], columns=["type", "method", "path", "problem"])

    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path", "length", "content", F.lit(p).alias("root")) for p in paths]
    if not parts:
        return spark.createDataFrame([], schema)
    files = parts[0]
    for x in parts[1:]:
        files = files.union(x)
    return files.mapInPandas(run, schema).distinct()


def known_types(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose type the index has, by its whole name or its last part."""
    types = index.where("type is not null").select("type").distinct()
    keys = types.select(F.explode(F.array_distinct(F.array("type", F.substring_index("type", ".", -1)))).alias("_key")).distinct()
    asked = names.withColumn("_plain", F.regexp_replace(name, r"^\.+", ""))
    both = asked.withColumn("_key", F.explode(F.array_distinct(F.array("_plain", F.substring_index("_plain", ".", -1)))))
    return both.join(keys, "_key", "left_semi").drop("_key", "_plain").distinct()


def known_methods(calls: DataFrame, index: DataFrame, owner: str = "owner", method: str = "method") -> DataFrame:
    """Rows whose method the index has for a type of the owner's last name."""
    have = index.where("method is not null").select(F.substring_index("type", ".", -1).alias("_owner"), F.col("method").alias("_method")).distinct()
    asked = calls.withColumns({"_owner": F.substring_index(owner, ".", -1), "_method": F.col(method)})
    return asked.join(have, ["_owner", "_method"], "left_semi").drop("_owner", "_method")
