"""The whole pipeline over tables with nulls and repeated ids, and over an empty one."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.cases import documents, frame


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece_ids", "n_pieces"} <= set(out.columns)


def test_nulls_and_repeated_ids(spark, tmp_path):
    good = " ".join(f"plain word number {k} stands here and nothing repeats it" for k in range(3))
    rows = [*documents(), (None, good, "en", "a", len(good)), (1, good + " once more", "en", None, 0), (30, None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(x.n_pieces == len(x.piece_ids) for x in out)
    assert {x.doc_id for x in out} <= {x[0] for x in rows}
