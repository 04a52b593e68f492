"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject, the Jaccard join keeps one document of each class, repeated
passages are cut out, sources are mixed to their target weights in training order, and texts become
piece ids. Stage functions take (spark, docs, sf_dir); all but the last return the columns of documents.

Defined results: a null text is judged, joined and cut as an empty one; rows of one id, null included, are judged each by
its own text; of rows alike in text one stays; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import jaccard, mixing, pieces, quality, suffixes
from skein.llm.common import Scratch, table

STAGES = [
    ("quality_rules", quality.stage),
    ("jaccard_join", jaccard.stage),
    ("repeated_passages", suffixes.stage),
    ("source_mix", mixing.stage),
    ("piece_encoding", pieces.stage),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents, one after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
