"""Thousands of rows alike, as a table with a default row has them."""

from __future__ import annotations

import hashlib
import random

from skein.llm import suffixes


def test_repeated_passages_of_rows_alike(spark):
    r = random.Random(1)
    text = "".join(r.choices("abcdefgh ", k=2000))
    rows = [(None, text)] * 5000 + [(1, text[:700] + "xxx"), (2, "y" + text[500:900])]
    got = suffixes.strip(spark, spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert len(got) == len(rows)
    want = {(None, 2000, 2000, 1, b""), (1, 703, 700, 1, b"xxx"), (2, 401, 400, 1, b"y")}
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == {(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in want}
