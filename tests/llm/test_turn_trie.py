"""The prefix trie against a brute-force one, over runs and ranges of all sizes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append(turn)
    own = {c: [(r or "", t or "") for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0))] for c, x in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = [*own.get(int(c / 20) * 20, [])[:h], *turns[h:]]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append((c, len(path)))
    words = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w])
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ids = ",".join(map(str, sorted(c for c, n in members if n == len(p))))
        saved = sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in below if q)
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        out.add((min(c for c, _ in members), len(p), up, len(members), children, sum(q not in inner for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def conversations(seed: int, n: int = 90):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(200), n):
        rows += [(c, t if t else None, r.choice(["user", "bot", None]), r.choice(["a b", "a  b c", None, "", "x\ty"])) for t in range(r.choice([1, 1, 2, 3, 6]))]
    rows += [(c, t, "user", "the same") for c in range(300, 360) for t in range(5)]  # a hot conversation
    rows += [(400, t, "user", f"turn {t // 3}") for t in range(120)]  # a long one
    r.shuffle(rows)
    return [*rows, (None, 1, "user", "nobody's"), (-5, 1, "u", "below zero"), (-5, 2, "u", "b"), (-5, 3, "u", "c"), (-5, 4, "u", "d")]


@pytest.mark.parametrize(("run", "span", "piece", "hot"), [(32_000_000, 8_000_000, 60_000, 1000), (200, 300, 9, 5), (60, 60, 1, 1)])
def test_equal_to_brute_force(spark, monkeypatch, run, span, piece, hot):
    for name, value in (("RUN", run), ("RANGE", span), ("PIECE", piece), ("HOT", hot)):
        monkeypatch.setattr(turn_trie, name, value)
    rows = conversations(span)
    extra = {n: F.lit("x") for n in ("key", "path", "n", "unit", "range", "depth")}
    got = turn_trie.trie(spark, turn_trie.rebuilt(spark.createDataFrame(rows, SCHEMA).withColumns(extra))).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(rows)


def test_merge_of_runs_keeps_order_and_prefixes():
    r = random.Random(5)
    unit = [bytes([k]) * turn_trie.UNIT for k in range(3)]
    for runs in (1, 2, 3, 7):
        every = sorted({b"".join(r.choices(unit, k=r.randrange(6))) for _ in range(60)})
        dealt = [[] for _ in range(runs)]
        for p in every:
            dealt[r.randrange(runs)].append(p)
        pieces = [[turn_trie.Item(turn_trie.common(a, b) if a is not None else 0, b, 0, 1) for a, b in zip([None, *x], x, strict=False)] for x in dealt if x]
        out = list(turn_trie.merged(pieces))
        assert [x.path for x in out] == every
        assert [x.lcp for x in out[1:]] == [turn_trie.common(a, b) for a, b in zip(every, every[1:], strict=False)]
    assert list(turn_trie.merged([])) == []


def test_empty_table(spark):
    assert turn_trie.trie(spark, turn_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
