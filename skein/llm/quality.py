"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
table of vote patterns estimates how right each rule is when it votes, for good and for bad documents;
the posterior probability of good quality, from the votes that were cast, then replaces a filter in which
every rule must pass. The pattern table has at most 3**rules rows whatever the corpus holds, so it is the
only thing that reaches the driver.

Defined results: a null text counts as empty (no words, base_failed); a null id stays null; repeated
rows are judged alike, and several texts under one id, or none, each by itself; an empty table gives no rows; columns of the input other than id and text are
not looked at, and none clashes with the results, which are made from those two alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Scratch, table

#: Fixed values of the symbol rule.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Chance of a vote to be right on good and on bad documents at the start (most rules find nothing amiss with most
#: bad documents), and documents of each class that hold it there.
START, PSEUDO = (0.98, 0.4), 10
#: Columns of features().
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_alpha")
_DROP = bytes(i for i in range(256) if i not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_LETTERS = bytes(i for i in range(128) if not chr(i).isalnum())
_SPACE = b" \t\n\x0b\x0c\r"
#: Common short words of the four languages of the corpus, used by one rule.
STOP = frozenset("the of and to in is that it for on was with as be der die und das den von zu mit le la les de des et en un une el los que y del se por".encode().split())


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text, first occurrences included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = np.uint64(int(ids.max()) + 1)
    code = ids[:n].astype(np.uint64)
    if int(base) ** window < 2**64:
        for k in range(1, window):
            code = code * base + ids[k : n + k].astype(np.uint64)
    else:  # number the windows exactly, one word at a time
        code = code.astype(np.int64)
        for k in range(1, window):
            _, code = np.unique(code * int(base) + ids[k : n + k], return_inverse=True)
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, len(raw.translate(None, _DROP)), 0, 0, 0, 0, 0)
    solid = raw.translate(None, _SPACE)
    chars = len(solid.translate(None, _CONTINUED))
    symbols = len(raw.translate(None, _DROP))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    # a text whose windows all start with different words can't repeat one
    repeats = repeated_words(ids) if len(first) < len(words) else 0
    stop = sum(map(STOP.__contains__, words))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), stop, len(solid.translate(None, _NOT_LETTERS).translate(None, _CONTINUED)))


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of docs, their columns (or those of `keep`) in a struct _sk_row, each with the counts of its text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features_of(t.as_py()) for t in b.column("_sk_text")], np.int64).reshape(b.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("_sk_row"), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["_sk_row", *COUNTS])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("_sk_row"), F.col(text_col).alias("_sk_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_sk_row"], *[T.StructField(n, T.LongType()) for n in COUNTS]]))


def _c(name: str) -> Column:
    return F.col(name)


def rules() -> dict[str, Column]:
    """Votes as columns over features(): +1 good, -1 bad, 0 abstains. Thresholds compare integers; n_alpha counts letters and digits."""
    n = _c("n_words")
    return {
        "length": F.when(n < 10, -1).when(n >= 50, 1).otherwise(0),
        "repeated_windows": F.when(100 * _c("n_repeat_words") > 20 * n, -1).when(100 * _c("n_repeat_words") <= 5 * n, 1).otherwise(0),
        "mean_word": F.when((_c("word_chars") > 20 * n) | (_c("word_chars") < 2 * n), -1).when((_c("word_chars") <= 12 * n) & (_c("word_chars") >= 3 * n), 1).otherwise(0),
        "symbols": F.when(10 * _c("n_symbols") > n, -1).when(100 * _c("n_symbols") <= 2 * n, 1).otherwise(0),
        "dup_lines": F.when(10 * _c("n_dup_lines") > 3 * _c("n_lines"), -1).when(_c("n_dup_lines") == 0, 1).otherwise(0),
        "stop_words": F.when(100 * _c("n_stop") >= 5 * n, 1).when(n >= 50, -1).otherwise(0),
        "letters": F.when((2 * _c("n_alpha") < _c("word_chars")) | ((n >= 50) & (10 * _c("n_alpha") < 7 * _c("word_chars"))), -1).when(10 * _c("n_alpha") >= 8 * _c("word_chars"), 1).otherwise(0),
    }


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.8) -> tuple[np.ndarray, float, np.ndarray]:
    """EM on distinct vote patterns with their counts: (accuracy of each rule, share of good, posterior of good).

    A rule that votes has its own chance of being right on good documents and on bad ones, so a rule that
    votes good on almost everything says little by it; a rule that abstains says nothing. A rule is never
    taken to be worse than chance: what it says for a class doesn't count against it. All rules start at
    START, and PSEUDO documents of each class hold them there where a table is small.
    """
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    right = np.repeat(np.array(START)[:, None], votes.shape[1], 1)  # of the good documents voted on, and of the bad ones
    share, post, total = prior, np.full(len(votes), prior), counts.sum()
    for _ in range(rounds if total else 0):
        says = up @ np.log(right[0] / (1 - right[1])) - down @ np.log(right[1] / (1 - right[0]))
        new = 1 / (1 + np.exp(np.clip(np.log((1 - share) / share) - says, -500, 500)))
        good, bad = counts * new, counts * (1 - new)
        right[0] = (good @ up + PSEUDO * START[0]) / (good @ (up + down) + PSEUDO)
        right[1] = (bad @ down + PSEUDO * START[1]) / (bad @ (up + down) + PSEUDO)
        low = right.sum(0) < 1  # worse than chance
        right[:, low] /= right[:, low].sum(0)
        share = float((good.sum() + PSEUDO * prior) / (total + PSEUDO))
        done, post = np.abs(new - post).max() < 1e-10, new
        if done:
            break
    truth = counts @ (up * post[:, None] + down * (1 - post[:, None]))
    return truth / np.maximum(counts @ (up + down), 1), share, post


def judge(spark: SparkSession, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Rows as in features(), with base_failed, posterior and kept: a posterior of `least` or more, and no base failure.

    What features() gives is written once to the shared folder: pattern counts and verdicts read that
    table instead of counting the texts again. Every document is counted.
    """
    scratch = Scratch(spark, "quality")
    feats = scratch.keep(features(docs, text_col, keep), "features")
    named = rules()
    voted = feats.withColumn("_sk_pattern", F.concat_ws(",", *[v.cast("string") for v in named.values()]))
    patterns = voted.groupBy("_sk_pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3**rules rows at most
    votes = np.array([[int(v) for v in r[0].split(",")] for r in patterns], dtype=float).reshape(-1, len(named))
    _, _, post = fit(votes, np.array([r[1] for r in patterns], dtype=float))
    known = spark.createDataFrame([(r[0], float(round(p, 12))) for r, p in zip(patterns, post, strict=True)], "_sk_pattern string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.join(F.broadcast(known), "_sk_pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop("_sk_pattern")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("_sk_row.doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents the rules keep, with the columns they came with; each row has a verdict of its own."""
    del sf_dir
    return judge(spark, docs).where("kept").select("_sk_row.*")
