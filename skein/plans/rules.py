"""How sure an edge is, by language, relation and outcome: a table of rules that outcomes are joined to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values. Rules of (languages, relation, outcome, confidence); * fits any. The most special rule that fits decides:
# one of the language and relation, then of the relation, then of the outcome alone.
_TYPED = ("java", "csharp", "go", "rust", "kotlin")
_PROFILED = (
    "vbnet vba lua haskell perl matlab cobol fortran r objectivec cuda groovy fsharp assembly hcl gdscript elixir zig julia pascal erlang ocaml clojure nim ada solidity"
).split()
RULES: tuple[tuple[tuple[str, ...], str, str, float], ...] = (
    (("*",), "*", "resolved", 1.0), (("*",), "*", "external", 0.7), (("*",), "*", "unresolved", 0.2), (("*",), "*", "unsupported", 0.1),
    (_TYPED, "imports", "external", 0.75), (("ruby", "swift"), "calls", "external", 0.65),
    (("javascript", "typescript"), "calls", "resolved", 0.95), (("javascript", "typescript"), "calls", "external", 0.5),
    (("javascript", "typescript"), "handles", "resolved", 0.9), (("javascript", "typescript"), "references", "resolved", 0.9), (("css",), "styles", "resolved", 0.85),
    (("dart", "scala"), "calls", "resolved", 0.85), (("dart", "scala"), "calls", "unresolved", 0.45),
    (tuple(_PROFILED), "imports", "external", 0.65), (tuple(_PROFILED), "inherits", "resolved", 0.45), (tuple(_PROFILED), "inherits", "unresolved", 0.45), (tuple(_PROFILED), "inherits", "external", 0.45),
    (tuple(_PROFILED), "calls", "resolved", 0.9), (tuple(_PROFILED), "calls", "unresolved", 0.4), (("shell", "powershell"), "uses", "external", 0.9),
)


def rows() -> list[tuple[str, str, str, float]]:
    return [(x, relation, status, c) for languages, relation, status, c in RULES for x in languages]


def with_confidence(outcomes: DataFrame, language: str = "language", relation: str = "relation_type", status: str = "resolution_status") -> DataFrame:
    """outcomes with the confidence of the rule that fits; null if none does. The table is of fixed size."""
    rules = outcomes.sparkSession.createDataFrame(rows(), "_l string, _r string, _s string, _c double")
    special = F.broadcast(rules.where("_l <> '*'").select(F.col("_l").alias(language), F.col("_r").alias(relation), F.col("_s").alias(status), F.col("_c").alias("_special")))
    general = F.broadcast(rules.where("_l = '*'").select(F.col("_s").alias(status), F.col("_c").alias("_general")))
    out = outcomes.join(special, [language, relation, status], "left").join(general, [status], "left")
    return out.withColumn("confidence", F.coalesce("_special", "_general")).select(*outcomes.columns, "confidence")
