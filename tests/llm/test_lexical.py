"""Ranked lexical search against a brute-force ranking."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import lexical
from tests.llm.cases import documents, frame, with_extra

PATTERN = re.compile(lexical.TERM)


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    words = [terms(t) for _, t in docs]
    n, every = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = set()
    for item, text in set(items):
        scores = []
        for (doc, _), w in zip(docs, words, strict=True):
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // max(1, every)
            score = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out |= {(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:10])}
    return out


def cases(seed):
    r = random.Random(seed)
    vocabulary = [f"t{int(r.paretovariate(0.6))}" for _ in range(400)]
    docs = [(k % 170 if k % 50 else None, " ".join(r.choices(vocabulary, k=r.randrange(60)))) for k in range(200)] + [(x[0], x[1]) for x in documents()]
    docs += [(500, "Straße ÄB-äb t1 T1 é日本"), (501, None), (502, "..."), (503, "copy of t7 t8"), (503, "copy of t7 t8")]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 12])))) for k in range(30)]
    return docs, [*items, (3, "another t1"), (3, "another t1"), (None, "t2 t2 copy"), (41, None), (42, "nowheretobefound"), (43, "straße äb É日本 ..")]


@pytest.mark.parametrize(("tiers", "items", "cells", "scored", "part"), [((1 / 16, 1 / 4), 2000, 2_000_000, 1_000_000, 2_000_000), ((0.01, 0.05), 7, 300, 20, 50), ((1.0, 1.0), 2000, 1, 1, 1)])
def test_equal_to_brute_force(spark, monkeypatch, tiers, items, cells, scored, part):
    for name, value in (("TIERS", tiers), ("ITEMS", items), ("CELLS", cells), ("SCORED", scored)):
        monkeypatch.setattr(lexical, name, value)
    cut = lexical.term_hashes
    monkeypatch.setattr(lexical, "term_hashes", lambda texts: cut(texts, part))
    docs, asked = cases(items)
    found = lexical.search(spark, with_extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), spark.createDataFrame(asked, "item_id long, text string").withColumn("term", F.lit(1)))
    got = found.collect()
    rows = [(x.item_id, x["rank"], x.doc_id, x.score) for x in got]
    assert len(rows) == len({x[:2] for x in rows}) + sum(1 for x in rows if x[0] == 3) // 2  # two items share the id 3
    assert set(rows) == brute(docs, asked)
    assert len({x.tier for x in got}) > 1 or tiers[0] == 1.0


def test_terms_are_cut_as_the_pattern_says():
    texts = [t for _, t, *_ in documents()] + ["aé1_b\x00C\u0085d", "x" * 100, ""]
    for most in (3, 50, 10**6):
        counted = Counter()
        for row, h in lexical.term_hashes(texts, most):
            counted.update(zip(row.tolist(), h.tolist(), strict=True))
        assert sum(counted.values()) == sum(len(terms(t)) for t in texts)
        assert len(counted) == sum(len(set(terms(t))) for t in texts)


def test_empty_tables(spark):
    empty, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(spark, frame(spark, []), items).count() == 0
    assert lexical.search(spark, frame(spark), empty).count() == 0
