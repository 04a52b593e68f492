"""Source trees as tables: which files there are, their language, and why some are skipped."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions by language; facts about the languages. The longest extension that fits wins.
EXTENSIONS = {
    "python": (".py", ".pyi"), "javascript": (".js", ".mjs", ".cjs", ".jsx"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "html": (".html", ".htm"), "css": (".css",),
    "c": (".c",), "cpp": (".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"), "java": (".java",), "csharp": (".cs",), "go": (".go",), "rust": (".rs",), "php": (".php",), "ruby": (".rb", ".rake"),
    "kotlin": (".kt", ".kts"), "swift": (".swift",), "dart": (".dart",), "scala": (".scala", ".sc"), "shell": (".sh", ".bash"), "powershell": (".ps1", ".psm1"),
    "sql": (".sql",), "mysql": (".mysql.sql",), "postgresql": (".pgsql", ".postgres.sql"), "tsql": (".tsql", ".mssql.sql"), "oracle": (".pls", ".pkb", ".pks", ".oracle.sql"),
    "lua": (".lua",), "perl": (".pl", ".pm"), "r": (".r",), "julia": (".jl",), "elixir": (".ex", ".exs"), "erlang": (".erl",), "haskell": (".hs",), "ocaml": (".ml", ".mli"), "fsharp": (".fs", ".fsx"),
    "clojure": (".clj", ".cljs"), "groovy": (".groovy",), "vbnet": (".vb",), "vba": (".bas", ".cls"), "fortran": (".f90", ".f95", ".f"), "pascal": (".pas",), "cobol": (".cob", ".cbl"), "ada": (".adb", ".ads"),
    "nim": (".nim",), "zig": (".zig",), "objectivec": (".m", ".mm"), "solidity": (".sol",), "matlab": (".matlab",),
    "cuda": (".cu", ".cuh"), "assembly": (".asm", ".s"), "hcl": (".tf", ".hcl"), "gdscript": (".gd",),
}


# Folders and files that are not looked at, and folders of generated ones.
EXCLUDED = [
    ".git/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/env/**", "**/build/**", "**/dist/**", "**/node_modules/**", "**/.next/**", "**/.cache/**", "**/*.g.cs",
    "**/*.designer.cs", "**/*.gen.go", "**/*.generated.rs", "**/*_generated.rs", "**/target/**", "**/vendor/**", "**/.build/**", "**/DerivedData/**", "**/Pods/**",
    "**/Carthage/**", "**/SourcePackages/**", "**/coverage/**", "**/*.generated.php", "**/*_generated.php", "**/*.generated.rb", "**/*_generated.rb", "**/*.generated.kt",
    "**/*_generated.kt", "**/*.generated.kts", "**/*_generated.kts", "**/*.generated.swift", "**/*_generated.swift", "**/*+Generated.swift", "**/*Generated.swift",
    "**/*.generated.scala", "**/*_generated.scala", "**/*.generated.vb", "**/*_generated.vb", "**/*.designer.vb", "**/*.generated.bas", "**/*_generated.bas", "**/*.generated.lua",
    "**/*_generated.lua", "**/*.generated.hs", "**/*_generated.hs", "**/*.generated.pl", "**/*_generated.pl", "**/*.generated.m", "**/*_generated.m", "**/*.generated.f90",
    "**/*_generated.f90", "**/*.generated.r", "**/*_generated.r", "**/*.generated.mm", "**/*_generated.mm", "**/*.generated.cu", "**/*_generated.cu", "**/*.generated.groovy",
    "**/*_generated.groovy", "**/*.generated.fs", "**/*_generated.fs", "**/*.generated.asm", "**/*_generated.asm", "**/*.generated.tf", "**/*_generated.tf", "**/*.generated.gd",
    "**/*_generated.gd", "**/*.generated.ex", "**/*_generated.ex", "**/*.generated.zig", "**/*_generated.zig", "**/*.generated.jl", "**/*_generated.jl", "**/*.generated.pas",
    "**/*_generated.pas", "**/*.generated.erl", "**/*_generated.erl",
]
GENERATED = ["**/Generated/**", "**/generated/**", "**/__generated__/**"]


@dataclass
class ScanConfig:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDED))
    generated: list[str] = field(default_factory=lambda: [*GENERATED, "**/*_pb2.py", "**/*.min.js"])
    tests: list[str] = field(default_factory=lambda: ["tests/**", "**/tests/**", "**/test_*.py", "**/*_test.go", "**/*Test.java"])
    with_tests: bool = False
    max_bytes: int = 2_000_000


def globs(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits: * crosses /, case doesn't count, and **/x fits x itself too."""
    every = [p for q in patterns for p in ([q, q[3:]] if q.startswith("**/") else [q])]
    if not every:
        return F.lit(False)
    return path.rlike("(?i)^(?:" + "|".join(fnmatch.translate(p).replace(r"\Z", "").replace(r"\z", "") for p in every) + ")$")


def language(path: Column) -> Column:
    """The language of the longest extension that the path ends with; null if none fits."""
    known = F.create_map(*[F.lit(x) for n, es in EXTENSIONS.items() for e in es for x in (e, n)])
    lower = F.lower(path)
    # extensions have one part or two
    return F.coalesce(*[F.try_element_at(known, F.regexp_extract(lower, pattern, 1)) for pattern in (r"(\.[^./]+\.[^./]+)$", r"(\.[^./]+)$")])


def skip_reason(path: Column, length: Column, config: ScanConfig) -> Column:
    """Null for a file to analyse; the first reason that fits otherwise."""
    out = F.when(~globs(path, config.include), "not_included").when(globs(path, config.exclude), "excluded")
    if not config.with_tests:
        out = out.when(globs(path, config.tests), "tests_excluded")
    return out.when(globs(path, config.generated), "generated").when(length.isNull(), "stat_failed").when(length > config.max_bytes, "file_too_large")


def _fits(path: str, patterns: list[str]) -> bool:
    low = path.casefold()
    return any(fnmatch.fnmatchcase(low, q.casefold()) for p in patterns for q in ([p, p[3:]] if p.startswith("**/") else [p]))


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, config: ScanConfig | None = None) -> DataFrame:
    """(path, language, length, content, reason) of the files under root in the languages.

    The driver lists names and sizes only, and never enters a folder that an exclude pattern takes whole
    (Spark's own file sources hide names that begin with _ or ., such as __init__.py). root is a folder
    that the executors share; they read the contents, and only if the query uses them.
    """
    config = config or ScanConfig()
    rows = []
    for folder, dirs, names in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if at == "." else at + "/"
        dirs[:] = sorted(d for d in dirs if not _fits(f"{prefix}{d}/x", config.exclude))
        for name in names:
            whole = os.path.join(folder, name)
            link = os.path.islink(whole)
            try:
                size = 0 if link else os.path.getsize(whole)
            except OSError:  # it has gone, or may not be looked at
                size = None
            rows.append((prefix + name, size, link))
    found = spark.createDataFrame(rows, "path string, length long, link boolean").withColumn("language", language(F.col("path")))
    # links are told of before anyone asks for their language
    wanted = F.col("language").isNotNull() if languages is None else F.coalesce(F.col("language").isin(languages), F.lit(False))
    found = found.where(F.col("link") | wanted)

    @F.pandas_udf(T.BinaryType())
    def content(paths: pd.Series) -> pd.Series:
        def read(path: str) -> bytes | None:
            try:
                with open(os.path.join(root, path), "rb") as f:
                    return f.read()
            except OSError:  # it went after it was listed
                return None

        return paths.map(read)

    reason = F.when(F.col("link"), "symlink").otherwise(skip_reason(F.col("path"), F.col("length"), config))
    found = found.withColumn("reason", reason).repartition(spark.sparkContext.defaultParallelism, "path")
    return found.withColumn("content", F.when(F.col("reason").isNull(), content("path"))).select("path", "language", "length", "content", "reason")


def skipped(files: DataFrame) -> DataFrame:
    """Diagnostics of skipped files."""
    code = F.when(F.col("reason") == "generated", "generated_file").otherwise("excluded_file")
    return files.where("reason is not null").select(code.alias("code"), F.lit("info").alias("severity"), F.concat_ws("", F.lit("Skipped file: "), "path", F.lit(" ("), "reason", F.lit(")")).alias("message"), F.col("path").alias("file")).distinct()
