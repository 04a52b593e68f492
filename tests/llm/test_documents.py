"""Operators over documents against brute force, on cases and on random tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import jaccard, language_model, mixing, pieces, quality, suffixes, token_counts
from tests.llm.cases import DOCS, documents, frame, with_extra, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_features_match_brute_force(spark):
    r = random.Random(3)
    texts = [t for _, t, *_ in documents()] + ["".join(r.choice("ab \n#|") for _ in range(r.randrange(120))) for _ in range(300)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in quality.judge(spark, with_extra(frame(spark, rows))).select("_sk_row.doc_id", *quality.COUNTS, "base_failed", "kept").collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        x, want = got[i], brute_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, (i, t)
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (x.base_failed and x.kept)


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [(i, "the " + " ".join(words(100, i, 3000)) + " of and to in the", "en", "s", 0) for i in range(60)]
    junk = [(100 + i, "### | $$$ " * 60, "en", "s", 0) for i in range(10)]
    got = {x.doc_id: x.kept for x in quality.judge(spark, frame(spark, clean + junk)).select("_sk_row.doc_id", "kept").collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_quality_stage_judges_texts_under_one_id_apart(spark):
    clean = ["the plan of the town is old and " + " ".join(words(90, i, 3000)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(0, "#" * 40, "en", "s", 40), (None, clean[1] + " and", "en", "s", 0), (None, "* " * 60, "en", "s", 120), (None, None, "en", "s", 0)]
    got = Counter((x.doc_id, x.text) for x in quality.stage(spark, frame(spark, rows), "").collect())
    assert got == Counter((i, t) for i, t, *_ in [*rows[:30], rows[31]])


def plain_em(votes, rounds=500):
    """The same model by loops over documents: (posterior of each, accuracies)."""
    n, k = len(votes), len(votes[0])
    right = [[quality.START[0]] * k, [quality.START[1]] * k]
    share, post = 0.8, [0.8] * n
    for _ in range(rounds):
        new = []
        for doc in votes:
            good, bad = math.log(share), math.log(1 - share)
            for r, v in enumerate(doc):
                if v:
                    good += math.log(right[0][r] if v > 0 else 1 - right[0][r])
                    bad += math.log(1 - right[1][r] if v > 0 else right[1][r])
            new.append(1 / (1 + math.exp(max(-500.0, min(500.0, bad - good)))))
        for r in range(k):
            for c, (vote, weight) in enumerate(((1, new), (-1, [1 - p for p in new]))):
                cast = sum(w for w, doc in zip(weight, votes, strict=True) if doc[r])
                hit = sum(w for w, doc in zip(weight, votes, strict=True) if doc[r] == vote)
                right[c][r] = (hit + 10 * quality.START[c]) / (cast + 10)
            both = right[0][r] + right[1][r]
            if both < 1:
                right[0][r], right[1][r] = right[0][r] / both, right[1][r] / both
        share = (sum(new) + 8) / (n + 10)
        done, post = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-10, new
        if done:
            break
    truth = [sum((p if doc[r] > 0 else 1 - p) for p, doc in zip(post, votes, strict=True) if doc[r]) / max(1, sum(1 for doc in votes if doc[r])) for r in range(k)]
    return post, truth


def test_quality_em_recovers_accuracies():
    r = np.random.default_rng(1)
    good = r.random(3000) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.7])
    right = r.random((3000, 4)) < acc
    votes = (np.where(right == good[:, None], 1, -1) * (r.random((3000, 4)) < 0.8)).astype(int)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    got, share, post = quality.fit(patterns.astype(float), counts.astype(float))
    assert np.abs(got - acc).max() < 0.06 and abs(share - 0.8) < 0.05
    assert ((post[where.ravel()] > 0.5) == good).mean() > 0.93
    want, truth = plain_em(votes.tolist())
    assert np.abs(post[where.ravel()] - want).max() < 1e-6 and np.abs(got - truth).max() < 1e-6


def test_quality_verdict_is_the_posterior_alone(spark):
    """The registered query against features by brute force, votes by hand and the plain EM; it drops labelled junk and rescues documents that one rule is against."""
    folder = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {x.doc_id: x for x in quality.op7_quality_rules(spark, folder).collect()}
    assert got.keys() == texts.keys()
    names = list(quality.rules())
    voted = {x["_sk_row"].doc_id: [x[n] for n in names] for x in quality.features(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).withColumns({n: c for n, c in quality.rules().items()}).collect()}
    post, _ = plain_em([voted[i] for i in texts])
    for (i, t), p in zip(texts.items(), post, strict=True):
        n, *_, repeats = brute_quality(t)
        failed = n < 10 or 100 * repeats > 20 * n
        assert got[i].base_failed == failed and got[i].kept == (not failed and round(p, 12) >= 0.5) and got[i].posterior == pytest.approx(p, abs=1e-6)


def test_mix_matches_brute_force(spark):
    rows = documents() + [(100 + i, " ".join(words(1 + i % 37, i)), "en", ("a", "b", "c", None)[i * i % 4], 0) for i in range(200)]
    got = mixing.mix(with_extra(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(WORD.findall(t or "")) for _, t, _, q, _ in rows if q == s) for s in {x[3] for x in rows}}
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    taken = Counter()
    for x in got:
        s = x.source
        assert x.source_size == size[s] and x.target == pytest.approx(target[s])
        assert x.size == len(WORD.findall(x.text or "")) and x.taken == x.passes * x.size <= 3 * x.size
        assert len(x.positions) == x.passes and all(0 <= p <= 1 for p in x.positions) and x.positions == sorted(x.positions)
        taken[s] += x.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(t or "")) for _, t, _, q, _ in rows if q == s)


def test_mix_follows_the_schedule(spark):
    """Of a source whose weight rises, a quarter of the words comes in the first half when weight doubles from 0."""
    rows = [(i, "a b c d e", "en", "s", 0) for i in range(4000)]
    ramp = lambda w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t).alias("w")) for t in (0.0, 1.0)])
    got = mixing.mix(frame(spark, rows), schedule=ramp).select(F.explode("positions").alias("p"))
    assert got.where("p < 0.5").count() / got.count() == pytest.approx(0.25, abs=0.01)
    order = [x._sk_position for x in mixing.in_training_order(mixing.mix(frame(spark, rows))).select("_sk_position").collect()]
    assert order == sorted(order)


def test_jaccard_stage_keeps_all_rows_without_words(spark):
    rows = [(1, "\t\n", "en", "s", 0)] * 2 + [(2, "  ", "en", "s", 0)] * 2 + [(3, "one two three four five six", "en", "s", 0)] * 2 + [(4, None, "en", "s", 0)] * 2
    assert sorted(x.doc_id for x in jaccard.stage(spark, frame(spark, rows), "").collect()) == [1, 1, 2, 2, 3, 4, 4]


def test_training_order_outlives_the_files(spark, tmp_path):
    rows = [(i, "a b c " * (1 + i % 9), "en", ("a", "b", "c")[i % 3], 0) for i in range(600)]
    docs = frame(spark, rows)
    mixing.stage(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    out = pieces.stage(spark, spark.read.parquet(str(tmp_path / "mixed")), "")
    got = [x.doc_id for x in out.orderBy("file", "file_row").collect()]
    assert got == [x.doc_id for x in mixing.in_training_order(mixing.mix(docs)).orderBy("_sk_position", "doc_id").collect()]
    assert "file" in pieces.stage(spark, docs, "").columns


def test_mix_stage_repeats_documents_and_keeps_columns(spark):
    rows = [(i, "a b c d", "en", s, 7) for i in range(90) for s in ("big",)] + [(1000 + i, "e f g h", "en", "small", 7) for i in range(10)]
    docs = with_extra(frame(spark, rows))
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    n = Counter(x.source for x in out.collect())
    assert n["small"] == 30 and n["big"] == 70


def test_encoding_equals_the_library_and_decodes(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(5)
    texts = [t for _, t, *_ in documents()] + ["".join(r.choice("aehtrions =\n你é-🎉") for _ in range(r.randrange(80))) for _ in range(400)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = pieces.decode(pieces.encode(with_extra(frame(spark, rows)))).collect()
    assert len(out) == len(rows)
    for x in out:
        t = texts[x.doc_id] or ""
        assert x.piece_ids == sp.encode(t)
        assert x.round_trip == (x.decoded == t) == ("▁" not in t)


def test_encoding_forgets_words_without_change():
    v = pieces.vocabulary(pieces.MODEL)
    texts = [" ".join(words(200, s, 5000)) for s in range(12)]
    small, large = pieces.Encoder(v, cache=50), pieces.Encoder(v)
    for t in texts:
        assert small.encode([t])[1].tolist() == large.encode([t])[1].tolist()


def brute_spans(texts, span=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(x[p : p + span] for x in raw for p in range(len(x) - span + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - span + 1):
            if n[x[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(n, seed):
    """Documents that share pieces of each other, some overlapping themselves."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randrange(100, 900))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts += [p[a : a + r.randrange(150, 500)], "".join(r.choice("xyz ") for _ in range(r.randrange(60)))]
        out.append("".join(parts))
    return [*out, "ab" * 300, "c" * 199, "c" * 200, "d" * 201]


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3000, 3])
def test_repeated_passages_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    texts = [t if len(t or "") < 9000 else t[:2000] for _, t, *_ in documents()] + passages(60, 2)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0)]
    got = suffixes.strip(spark, with_extra(frame(spark, rows)), batches=3).collect()
    assert len(got) == len(rows)
    want = brute_spans([x[1] for x in rows])
    by_row = {(i, t): w for (i, t, *_), w in zip(rows, want, strict=True)}
    for x in got:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == by_row[x.doc_id, x.text]


def test_index_family_keeps_levels_logarithmic(spark):
    from skein.llm.common import KEY, Scratch

    scratch = Scratch(spark, "test")
    family = suffixes.IndexFamily(scratch)
    rows = [(i, " ".join(words(150, i)), "en", "s", 0) for i in range(8)]
    sizes = []
    for x in [*rows, rows[2]]:
        keyed = frame(spark, [x]).select(F.col("doc_id").cast("string").cast("binary").alias(KEY), F.col("text").alias("_sk_text"))
        new = family.add(suffixes.entries(keyed))
        sizes.append([s for s, _ in family.levels])
        assert (new.count() > 0) == (len(sizes) == 9)
    assert sizes == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0], [3], [3, 0]]
    assert family.array().agg(F.sum("c")).first()[0] == sum(suffixes.entries(keyed_all).count() for keyed_all in [frame(spark, [*rows, rows[2]]).select(F.lit(b"k").alias(KEY), F.col("text").alias("_sk_text"))])


def test_repeated_passages_split_a_hot_gram(spark):
    """One gram whose differing pieces hold more than CROWD bytes, as shipped."""
    r = random.Random(12)
    common = "".join(r.choice("abcdefgh ") for _ in range(260))
    edge = lambda n: "".join(r.choice("pqrstuvw ") for _ in range(n))
    texts = [edge(60) + common[r.randrange(30) : 260 - r.randrange(30)] + edge(60) for _ in range(14_000)]
    texts += [common[:230], edge(40) + common[20:219] + edge(40)]
    got = suffixes.strip(spark, frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), with_text=False).collect()
    n = Counter(hash(x[p : p + 200]) for x in texts for p in range(len(x) - 199))
    assert sum(len(x) for x in texts) > suffixes.CROWD
    for x in got:
        t = texts[x.doc_id]
        gone = [p for p in range(len(t) - 199) if n[hash(t[p : p + 200])] > 1]
        runs = suffixes.merged([(p, 200) for p in gone])
        assert (x.n_removed, x.n_spans) == (sum(b - a for a, b in runs), len(runs))


def test_anchor_is_the_leftmost_least():
    r = np.random.default_rng(4)
    v = r.integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 5, 169):
        assert suffixes.sliding_argmin(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(len(v) - width + 1)]


def test_long_texts_are_fingerprinted_in_parts():
    texts = ["ab" * 700, None, "x" * 199, "".join(words(300, 5))]
    whole = list(suffixes._parts(texts, 200, 10_000))
    cut = list(suffixes._parts(texts, 200, 300))
    strings = lambda parts: sorted((k, o + p) for rows, offsets, held in parts for k, o, x in zip(rows, offsets, held, strict=True) for p in range(len(x) - 199))
    assert len(cut) > len(whole) and strings(cut) == strings(whole)


def brute_classes(rows):
    def grams(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t, *_ in rows]
    link = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                link[a].add(b), link[b].add(a)
    root = {}
    for a in range(len(rows)):
        if a not in root:
            group, todo = {a}, [a]
            while todo:
                for b in link[todo.pop()] - group:
                    group.add(b), todo.append(b)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            root |= dict.fromkeys(group, min(ids, default=None))
    return [(rows[k][0], root[k], len(link[k])) for k in range(len(rows))]


@pytest.mark.parametrize(("small", "tile"), [(256, 150_000), (4, 300)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, small, tile):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(9)
    rows = [x for x in documents() if x[0] is not None and len(x[1] or "") < 20_000]
    for g in range(6):
        base = words(r.randrange(20, 150), 50 + g)
        for k in range(1 + 5 * g):
            w = [*base]
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((1000 + 100 * g + k, " ".join(w), "en", "s", 0))
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard.classes(spark, with_extra(frame(spark, rows))).collect())
    assert got == sorted(brute_classes(rows))


def test_jaccard_stage_keeps_one_of_each_class(spark):
    rows = documents()
    out = jaccard.stage(spark, with_extra(frame(spark, rows)), "")
    ids = [x.doc_id for x in out.collect()]
    want = Counter()
    seen = set()
    for (i, t, *_), (_, cls, _) in zip(rows, brute_classes(rows), strict=True):
        if not WORD.search(t or ""):
            want[i] += 1
        elif i == cls and (i, t) not in seen:
            seen.add((i, t))
            want[i] += 1
    assert Counter(ids) == want


def test_lm_scores_match_counts_and_improve(spark):
    rows = documents() + [(100 + i, " ".join(x for w in words(30, i, 40) for x in (w, w[:3] + "next")), "en", "s", 0) for i in range(150)]
    got = language_model.score(spark, with_extra(frame(spark, rows)).drop("score")).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    toks = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w := toks(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t, *_ in rows)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    mine = [x for x in got if x.held_out and (x.doc_id or 0) >= 100]
    assert sum(x.score for x in mine) > sum(x.base_score for x in mine)


def test_lm_is_normalised():
    r = np.random.default_rng(2)
    log_p = language_model.train(r.integers(0, 50, (40, 40)).astype(float), dim=8, rounds=60)
    assert np.allclose((10**log_p).sum(1), 1)
    assert np.allclose(language_model.train(np.zeros((5, 5))), -np.log10(5))
    assert [language_model.symbols_for(x) for x in (0, 2**18, 2**24 - 1, 2**24, 2**30, 2**36)] == [512, 512, 512, 1024, 2048, 4096]


def test_lm_learns_its_table():
    r = np.random.default_rng(4)
    p = r.dirichlet(np.full(30, 0.2), 30)
    n = np.array([r.multinomial(5000, x) for x in p]).astype(float)
    log_p = language_model.train(n, dim=24)
    cross = -(p * log_p).sum(1).mean()
    best = -(p * np.log10(np.maximum(p, 1e-12))).sum(1).mean()
    alone = -(p * np.log10(n.sum(0) / n.sum())).sum(1).mean()
    assert best <= cross < best + 0.25 * (alone - best)


def test_token_rollup_is_idempotent_and_signed(spark, tmp_path):
    rows = documents()
    counts = token_counts.counted(frame(spark, rows)).cache()
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_counts.inserts(counts)) and not rollup.commit("one", token_counts.inserts(counts))
    want = Counter()
    for x in counts.collect():
        want[x.source, x.lang, x.tokenizer, "d"] += 1
        want[x.source, x.lang, x.tokenizer, "t"] += x.n_tokens
    total = lambda: {(x.source, x.lang, x.tokenizer, k): v for x in rollup.totals().collect() for k, v in (("d", x.n_docs), ("t", x.n_tokens))}
    assert total() == dict(want)
    some = counts.where("doc_id = 4 and tokenizer = 'words-1'")
    assert rollup.commit("gone", token_counts.deletes(some)) and rollup.commit("none", token_counts.inserts(counts.where("false")))
    x = some.first()
    want[x.source, x.lang, x.tokenizer, "d"] -= 1
    want[x.source, x.lang, x.tokenizer, "t"] -= x.n_tokens
    other = counts.where("doc_id = 13 and tokenizer = 'words-1'")
    assert rollup.commit("revised", token_counts.revisions(other.withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", F.col("n_tokens") + 5)))
    y = other.first()
    want[y.source, y.lang, y.tokenizer, "t"] += 5
    expected = {k: v for k, v in want.items() if want[(*k[:3], "d")] or want[(*k[:3], "t")]}
    assert total() == expected
    rollup.compact()
    assert total() == expected and rollup.batches() == {"one", "gone", "none", "revised"}
    assert not rollup.commit("gone", token_counts.deletes(some)) and total() == expected


def test_token_rollup_survives_races_and_crashes(spark, tmp_path, monkeypatch):
    counts = spark.createDataFrame([("s", "en", "v", 1, 10)], token_counts.DELTA)
    rollup, other = (token_counts.Rollup(spark, str(tmp_path / "rollup")) for _ in range(2))
    total = lambda: [tuple(x)[3:] for x in rollup.totals().collect()]
    assert rollup.commit("one", counts)
    # the second writer has read the state before the first one wrote: one batch of a name counts, two of different names both do
    stale, real = other._state(), token_counts.Rollup._state
    assert rollup.commit("two", counts)
    left = [stale, stale]
    monkeypatch.setattr(token_counts.Rollup, "_state", lambda self: left.pop() if self is other and left else real(self))
    assert not other.commit("two", counts) and total() == [(2, 20)]
    left += [stale, stale]
    assert other.commit("three", counts) and total() == [(3, 30)]
    # a compaction that began before another commit keeps it
    before = real(other)
    assert rollup.commit("four", counts)
    left += [before, before]
    assert other.compact() and total() == [(4, 40)] and rollup.batches() == {"one", "two", "three", "four"}
    # a writer that died after its table, or within its state, or a compaction that died before its state, changes nothing
    rollup._table(counts)
    (tmp_path / "rollup" / "states" / f"{real(rollup)[0] + 1:012d}").write_text('{"half')
    with monkeypatch.context() as m:
        m.setattr(token_counts.Rollup, "_write", lambda self, number, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rollup.compact()
    assert total() == [(4, 40)] and rollup.commit("five", counts) and total() == [(5, 50)]
    assert rollup.compact() and total() == [(5, 50)] and not rollup.compact()


def test_token_query_counts_words_as_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    sql = r"""SELECT source, lang, count(*), CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT)
        FROM '/root/testdata/sf0.001/documents.parquet' GROUP BY source, lang"""
    got = token_counts.op10_token_counts(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(x) for x in got.where("tokenizer = 'words-1'").drop("tokenizer").collect()) == sorted(duckdb.sql(sql).fetchall())


def test_token_query_revises_deletes_and_compacts(spark, tmp_path, monkeypatch):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    said, folded = [], []
    commit, compact = token_counts.Rollup.commit, token_counts.Rollup.compact
    monkeypatch.setattr(token_counts.Rollup, "commit", lambda self, b, c: said.append((commit(self, b, c), {x.n_docs for x in c.collect()})) or said[-1][0])
    monkeypatch.setattr(token_counts.Rollup, "compact", lambda self: folded.append(len(self.batches())) or compact(self))
    got = Counter({(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in token_counts.op10_token_counts(spark, str(tmp_path)).collect()})
    want = token_counts.counted(frame(spark)).groupBy("source", "lang", "tokenizer").agg(F.count(F.lit(1)).alias("d"), F.sum("n_tokens").alias("t")).collect()
    assert got == {(x.source, x.lang, x.tokenizer): (x.d, x.t) for x in want}
    assert {1, 0, -1} <= set().union(*(kinds for new, kinds in said if new)) and not all(new for new, _ in said)
    assert len(folded) == 2 and folded[1] > folded[0] > token_counts.BATCHES


def test_token_counts_are_those_of_the_vocabulary(spark):
    enc = token_counts.encoder()
    for x in token_counts.counted(frame(spark)).where("tokenizer = 'byte_bpe_50k'").join(frame(spark).select("doc_id", "text"), "doc_id").where("doc_id < 13").collect():
        assert x.n_tokens == len(enc.encode_ordinary(x.text or ""))


def test_token_query_over_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert token_counts.op10_token_counts(spark, str(tmp_path)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.judge(spark, none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.stage(spark, none, "").count() == 0
    assert pieces.encode(none).count() == 0
    assert suffixes.strip(spark, none).count() == 0
    assert jaccard.classes(spark, none).count() == 0
    assert language_model.score(spark, none).count() == 0
    assert token_counts.counted(none).count() == 0


def test_texts_without_words_only(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n", "en", "a", 0)]
    docs = frame(spark, rows)
    assert not any(x.kept for x in quality.judge(spark, docs).collect())
    assert {x.taken for x in mixing.mix(docs).collect()} == {0}
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard.classes(spark, docs).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert {x.n_removed for x in suffixes.strip(spark, docs).collect()} == {0}
    assert {x.n_tokens for x in language_model.score(spark, docs).collect()} == {1}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rows = documents() + [(200 + i, "the " + " ".join(words(90, 200 + i, 3000)), "en", ("a", "b")[i % 2], 500) for i in range(40)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {x.doc_id for x in docs.select("doc_id").collect()}
    assert len(ids & set(range(200, 240))) >= 20
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: Counter((x.doc_id, tuple(x.piece_ids)) for x in d.collect())
    assert key(again) == key(docs)
