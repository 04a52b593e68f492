"""Schemas of the graph tables and the closed value sets of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")])
RETURN_SITE = T.StructType([T.StructField("span", SPAN), T.StructField("value_kind", T.StringType())])


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: extensions and detail are open objects and stay JSON text; language is promoted to a column.
NODES = T.StructType(
    [
        *_fields("id", "kind", "qualified_name", "display_name", "file"),
        T.StructField("span", SPAN),
        *_fields("parent_id", "visibility", "signature", "return_behavior", "execution_kind"),
        T.StructField("return_sites", T.ArrayType(RETURN_SITE)),
        *_fields("language", "extensions"),
    ]
)
EDGES = T.StructType([*_fields("id", "source_id", "target_id", "relation_type", "resolution_status", "provenance"), T.StructField("confidence", T.DoubleType()), T.StructField("source_span", SPAN), *_fields("detail", "extensions")])
DIAGNOSTICS = T.StructType([*_fields("code", "severity", "message", "file"), T.StructField("span", SPAN), *_fields("node_id", "edge_id", "details", "extensions")])

#: Fixed values of the graph contract.
NODE_KINDS = ("module", "namespace", "class", "function", "method", "lambda", "interface", "type", "element", "style_rule", "external", "unknown")
RESOLUTION_STATUSES = ("resolved", "external", "unresolved", "unsupported")
PROVENANCES = ("ast", "lsp", "runtime", "manual", "unknown")
RETURN_BEHAVIORS = ("no_explicit_return", "returns_value", "returns_none", "mixed", "unknown")
EXECUTION_KINDS = ("sync", "async", "generator", "async_generator", "suspend", "unknown")
VISIBILITIES = ("public", "private", "unknown")
SEVERITIES = ("info", "warning", "error")
RELATIONS = ("contains", "imports", "dynamic_imports", "calls", "inherits", "uses", "exports", "references", "handles", "styles", "reads", "writes", "joins", "defines", "triggers")
