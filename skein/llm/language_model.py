"""Language-model scores of texts: unigram counts and a log-bilinear model trained by noise-contrastive estimation.

Counts of every token of every training text are kept in a table. The HEAD most frequent tokens at most
go to the workers as a dictionary; the rest is looked up by a join, so no table that grows with the
corpus is broadcast. The model predicts a symbol (one of the most frequent words, the end of the text,
or a class of rarer words by their last letters) from the symbol before it: s(w|h) = q_h C q_w + b_w,
with one embedding per symbol. The number of symbols grows with the training text (symbols_for). The
numbers of all pairs of neighbouring symbols in all training texts are what it learns from: each pair seen
is told from NOISE draws of the unigram distribution after the same symbol, drawn anew every REDRAW
rounds; pairs alike are drawn for together, which costs a draw for each cell of the table and not for each
token. One matrix product over all symbols then gives the scores, and their log-sum-exp normalises them. A
rare word has the probability of its class times its smoothed share of the class, so a text's probability
is over all words, known or not.

Defined results: a null text is empty and has one token, the end; a null id counts as the empty string
when rows are dealt to training and held-out; rows alike are scored alike; without training rows every
count is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, table

#: Tokens in the workers' dictionary at most, and symbols of the model: words, classes of other words, the end.
HEAD = 131_072
#: Bytes of a token in that dictionary at most; longer ones are looked up by the join, however frequent.
LONGEST = 64
CLASSES = 64
#: Symbols of a model of 2**18 tokens or more; twice as many for each further factor of 64.
LEAST_SYMBOLS = 512
DIM, NOISE, ROUNDS, REDRAW, RATE = 32, 10, 300, 25, 0.05
#: Numbers of the symbols: the classes, the end, then the words.
_END, _FIRST = CLASSES, CLASSES + 1
#: The end of a text as a token; no word is empty.
END = b""
_FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, and the end. bytes.split() splits at space and the controls 9 to 13 only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES if word else _END


def symbols_for(total: int) -> int:
    """Symbols of the model of so many training tokens: the table of their pairs grows as the cube root of the corpus."""
    return LEAST_SYMBOLS << max(0, (int(total).bit_length() - 19) // 6)


def _texts(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[list[list[bytes]]]:
    for b in batches:
        part, size = [], 0
        for t in b.column("_sk_text"):
            t = t.as_py()
            part.append(tokens(t))
            size += len(t or "")
            if size > most:
                yield part
                part, size = [], 0
        if part:
            yield part


def token_counts(training: DataFrame) -> DataFrame:
    """(token, class, c) over all rows of _sk_text; counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = list(n)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([word_class(w) for w in words], pa.int32()), pa.array(n.values(), pa.int64())], ["token", "class", "c"])

        n: Counter = Counter()
        for part in _texts(batches):
            for words in part:
                n.update(words)
            if len(n) > _FLUSH:
                yield rows()
                n = Counter()
        if n:
            yield rows()

    found = training.select("_sk_text").mapInArrow(run, "token binary, class int, c long")
    return found.groupBy("token", "class").agg(F.sum("c").alias("c"))


class Head:
    """The frequent tokens in order, the most frequent first: their counts and classes, and a dictionary made once per task."""

    def __init__(self, words: list[bytes], counts: list[int], size: int = LEAST_SYMBOLS) -> None:
        self.words, self.counts, self.size = words, np.array(counts, np.int64), size
        self.own = np.array([bool(w) and k < size - _FIRST for k, w in enumerate(words)], bool)  # words that are symbols
        self.symbols = np.array([_FIRST + k if own else word_class(w) for k, (w, own) in enumerate(zip(words, self.own.tolist(), strict=True))], np.int64)

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def head_of(counts: DataFrame, most: int = HEAD, size: int = LEAST_SYMBOLS) -> Head:
    """All tokens whose count reaches a threshold that at most `most` tokens reach.

    The thresholds tried are powers of 2**(1/16), so the histogram they need has a thousand rows at most.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = sorted(((int(r[0]), r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if total + n > most:
            break
        total, least = total + n, s
    if least is None:
        return Head([], [], size)
    rows = counts.where((step >= least) & (F.octet_length("token") <= LONGEST)).select("token", "c").collect()
    rows.sort(key=lambda r: (-r[1], bytes(r[0])))
    return Head([bytes(r[0]) for r in rows], [r[1] for r in rows], size)


def _ids(index: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))


def _symbols(head: Head, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = head.symbols[ids] if len(head.words) else np.full(len(ids), _END)
    for k in np.flatnonzero(ids < 0).tolist():
        out[k] = word_class(words[k])
    return out


def pair_counts(training: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(cell, n): numbers of neighbouring symbols, cell = before * symbols + after. A text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        index, n = head.index(), np.zeros(head.size * head.size, np.int64)
        for part in _texts(batches):
            words = [w for x in part for w in x]
            after = _symbols(head, _ids(index, words), words)
            before = np.concatenate([[_END], after[:-1]])  # the token before a text's first is another text's end
            n += np.bincount(before * head.size + after, minlength=len(n))
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    return training.select("_sk_text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def train(pairs: np.ndarray, dim: int = DIM, noise: int = NOISE, rounds: int = ROUNDS, rate: float = RATE, seed: int = 5) -> np.ndarray:
    """Normalised log10 probabilities, before x after, of a log-bilinear model fitted to the pair counts.

    Each pair seen is told from `noise` draws of the unigram distribution after the same symbol; Adam on
    the whole table. Without pairs every symbol is as likely as any other.
    """
    k = len(pairs)
    total = pairs.sum()
    if not total:
        return np.full((k, k), -np.log10(k))
    data = (pairs / total).astype(np.float32)
    unigram = (data.sum(0, dtype=np.float64) + 1e-7) / (1 + 1e-7 * k)
    unigram /= unigram.sum()
    draws = noise * pairs.sum(1).astype(np.int64)
    log_noise = np.log(noise * unigram).astype(np.float32)[None, :]
    r = np.random.default_rng(seed)
    p = {"q": 0.1 * r.standard_normal((k, dim)), "c": np.eye(dim) + 0.1 * r.standard_normal((dim, dim)), "b": np.log(unigram)}
    p = {n: x.astype(np.float32) for n, x in p.items()}
    m, v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        if t % REDRAW == 1:
            against = (r.multinomial(draws, unigram) / total).astype(np.float32)
        turned = p["q"] @ p["c"]
        true = 1 / (1 + np.exp(np.clip(log_noise - turned @ p["q"].T - p["b"], -60, 60)))
        slope = against * true - data * (1 - true)
        back = slope @ p["q"]
        grad = {"q": back @ p["c"].T + slope.T @ turned, "c": p["q"].T @ back, "b": slope.sum(0)}
        now = rate * (1 - t / (rounds + 1))
        for n, g in grad.items():
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            p[n] -= (now * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
    q, c, b = (p[n].astype(np.float64) for n in ("q", "c", "b"))
    score = q @ c @ q.T + b
    top = score.max(1, keepdims=True)
    return (score - top - np.log(np.exp(score - top).sum(1, keepdims=True))) / np.log(10)


def _scored(docs: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """Per row: what the dictionary and the model give, and the other tokens with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, table_, whole, n_class, v_class = shared.value
        index, base = head.index(), np.log10((head.counts + 0.5) / whole)
        inside = np.where(head.own | (head.symbols == _END), 0.0, np.log10((head.counts + 0.5) / (n_class + 0.5 * (v_class + 1))[np.minimum(head.symbols, _END)]))
        for b in batches:
            done = 0
            for part in _texts(iter([b])):
                words = [w for x in part for w in x]
                ids = _ids(index, words)
                sym = _symbols(head, ids, words)
                before = np.concatenate([[_END], sym[:-1]])
                known = ids >= 0
                some = len(head.words) > 0
                model = table_[before, sym] + (np.where(known, inside[ids], 0.0) if some else 0.0)
                plain = np.where(known, base[ids], 0.0) if some else np.zeros(len(ids))
                lens = np.array([len(x) for x in part])
                starts = np.cumsum(lens) - lens
                rest: list[list[dict]] = []
                for s, e in zip(starts.tolist(), (starts + lens).tolist(), strict=True):
                    other = Counter(words[s + k] for k in np.flatnonzero(~known[s:e]).tolist())
                    rest.append([{"token": w, "class": word_class(w), "m": m} for w, m in other.items()])
                cols = [b.column(n).slice(done, len(part)) for n in ("_sk_row", "doc_id", "held_out")]
                done += len(part)
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), plain, model)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(lens.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(rest, pa.list_(pa.struct([("token", pa.binary()), ("class", pa.int32()), ("m", pa.int64())])))],
                    ["_sk_row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rest"],
                )

    return docs.mapInArrow(run, "_sk_row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rest array<struct<token:binary,class:int,m:long>>")


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    scratch = Scratch(spark, "lm")
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_sk_text"), (F.crc32(id_text) % folds == held).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = scratch.keep(token_counts(training), "counts")
    by_class = {r[0]: (r[1], r[2]) for r in counts.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect()}  # CLASSES + 1 rows
    n, v = (sum(x[k] for x in by_class.values()) for k in (0, 1))
    whole = n + 0.5 * (v + 1)
    size = symbols_for(n)
    head = head_of(counts, size=size)
    pairs = np.zeros(size * size)
    shared = spark.sparkContext.broadcast(head)  # HEAD tokens at most
    cells = pair_counts(training, shared).toArrow()  # size ** 2 cells at most
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    log_p = train(pairs.reshape(size, size))
    n_class, v_class = np.zeros(_FIRST), np.zeros(_FIRST)
    for c, (a, b) in by_class.items():
        n_class[c], v_class[c] = a, b
    # the most frequent words are symbols of their own and have left their classes
    for k in np.flatnonzero(head.own).tolist():
        c = word_class(head.words[k])
        n_class[c] -= head.counts[k]
        v_class[c] -= 1
    model = spark.sparkContext.broadcast((head, log_p, whole, n_class, v_class))
    parts = scratch.keep(_scored(rows.withColumn("_sk_row", F.monotonically_increasing_id()).select("_sk_row", "doc_id", "held_out", "_sk_text"), model), "parts")
    smooth = F.create_map(*[F.lit(x) for c in range(CLASSES) for x in (c, float(n_class[c] + 0.5 * (v_class[c] + 1)))])
    rest = parts.select("_sk_row", F.explode("rest").alias("r")).select("_sk_row", "r.token", "r.class", "r.m")
    found = rest.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("_sk_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / whole)).alias("base_rest"),
        F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / smooth[F.col("class")])).alias("model_rest"),
    )
    out = parts.drop("rest").join(sums, "_sk_row", "left")
    zero = F.lit(0)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("known_rest", zero)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("model_rest", F.lit(0.0))).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
