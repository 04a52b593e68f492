"""Small tables with the cases that every operator has to take: nulls, empty and long texts, ties, rows alike, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):03d}" + "abé"[r.randrange(3)] for _ in range(n)]


def documents() -> list[tuple]:
    base, other = words(120, 1), words(300, 2)
    near = [*base]
    near[60] = "changed"
    shared = " ".join(words(60, 3))
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(other)), (5, None), (6, ""), (7, "   \n "),
        (8, "one two"), (9, "one two"), (10, shared + " " + " ".join(words(80, 4))), (11, " ".join(words(50, 5)) + "\n" + shared),
        (12, "x" * 5000 + " é " + "y" * 300), (13, " ".join(words(30_000, 6, 5000))), (14, "a b c d e f g h i j " * 40), (None, "no id at all " + " ".join(words(40, 7))),
        (15, "line one is here\nline one is here\nlast"), (15, "same id, other text"), (16, " ".join(words(90, 8))), (16, " ".join(words(90, 8))),
        (17, "\x00 odd \u2028 text\x0bwith▁mark"), (18, "🎉 " * 30),
    ]
    return [(i, t, "en" if k % 2 else None, (None, "a", "b", "ü")[k % 4], len(t or "")) for k, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)


def with_extra(df):
    """Extra columns whose names clash with those of results and of internal columns."""
    from pyspark.sql import functions as F

    extra = {n: F.lit("x") for n in ("size", "target", "kept", "n_words", "score", "m", "h", "node", "component", "bucket", "spans", "n_removed", "piece_ids", "text2")}
    return df.withColumns(extra)
