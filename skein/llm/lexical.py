"""Ranked lexical search over a tiered index.

The index is kept by document: a row has, for each tier, the asked terms of the document and their impacts (the share
of a score that does not depend on the term's weight). A term's postings of highest impact make up tier 0, the next
ones tier 1, and the rest tier 2, so that the first tiers hold about TIERS of all documents for a frequent term and
everything for a rare one. What a document may still get from the tiers below is bounded for every term by the highest
impact there, its residual.

A tier's pass reads no tier below. Scores of what was read are lower bounds, and the 10th best of them is an item's
mark. If the residuals of all its terms together stay under the mark, no document unseen can be among the 10 best: the
item is proven, and only documents whose upper bound reaches the mark are scored to the end, from the lower tiers too.
Items without that proof fall through to the next tier; the last has no residuals, so it proves all that is left.

Items are the stated query set and go in blocks of ITEMS, each with an index of the terms that it asks for. Scores are
whole numbers below 2**53, so sums in doubles are exact. Two terms are the same if 64 bits of hash are.

Defined results: a null text has no terms; an item without terms, or whose terms no document has, gets no rows; rows
alike are documents each, with ranks of their own; equal scores come by ascending id, null last; items alike in id and
text count once; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Scratch, table
from skein.llm.hashing import Prefixes

#: A term is a maximal run of ASCII letters and digits and of all other characters; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Shares of all documents that a term's postings of tier 0, and of tiers 0 and 1, may hold.
TIERS = (1 / 16, 1 / 4)
#: Impacts are below LIMIT; bounds of tiers are multiples of LIMIT / STEPS.
LIMIT, STEPS = 1_000_000, 100
#: Items of a block, bytes of text hashed at once, cells (document, item) and postings scored at once.
ITEMS, SLICE, CELLS, SCORED = 2000, 2_000_000, 2_000_000, 1_000_000

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_TERM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122))


def _parts(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts of about `most` bytes with the rows that they are of; longer texts are cut between terms."""
    rows, held, size = [], [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        begin = 0
        while begin < len(raw):
            end = begin + most
            if end < len(raw):
                stops = np.flatnonzero(~_IS_TERM[np.frombuffer(raw, np.uint8, most, begin)])
                end = begin + int(stops[-1]) + 1 if len(stops) else end
                while not len(stops) and end < len(raw) and _IS_TERM[raw[end]]:
                    end += 1
            rows.append(k), held.append(raw[begin:end])
            size += len(held[-1])
            begin = end
            if size > most:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def term_hashes(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every term of the texts, in runs."""
    for rows, held in _parts(texts, most):
        data = _LOWER[np.frombuffer(b"\n".join(held) + b"\n", np.uint8)]
        inside = np.concatenate([[False], _IS_TERM[data]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])  # data ends outside: edges pair up
        start, end = edge[0::2], edge[1::2]
        lens = np.array([len(x) + 1 for x in held])
        counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)])))
        yield np.repeat(np.array(rows), counts), Prefixes(data).of(start, end)


class Asked:
    """The asked terms by their sorted hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        top = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(1 << 20))
        self.run = int(np.bincount(top).max()) if len(top) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, -1 if it is not asked for."""
        out = np.full(len(h), -1, np.int64)
        at = self.first[(h >> np.uint64(44)).astype(np.int64)]
        for k in range(self.run):
            place = np.minimum(at + k, len(self.hashes) - 1)
            out = np.where(self.hashes[place] == h, place, out)
        return out


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def forward(docs: DataFrame, asked: Asked, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and its asked terms with their occurrences. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(1, len(asked.hashes))
        for b in batches:
            n, codes, times = np.zeros(b.num_rows, np.int64), [], []
            for row, h in term_hashes(b.column("_sk_text").to_pylist()):
                n += np.bincount(row, minlength=b.num_rows)
                term = asked.find(h)
                code, count = np.unique((row * many + term)[term >= 0], return_counts=True)
                codes.append(code), times.append(count)
            code, where = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
            tf = np.bincount(where, np.concatenate([np.zeros(0, np.int64), *times]), len(code))
            offsets = np.searchsorted(code, np.arange(b.num_rows + 1) * many)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), _list(code % many, offsets), _list(tf, offsets)], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_sk_text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Items(NamedTuple):
    """A block of items by term: of term t the entries begin[t]:begin[t + 1] are (item, how often it is asked)."""

    ids: list[int | None]
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> tuple[Items, Asked]:
        found = list(term_hashes([t for _, t in rows]))
        row, h = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(zip(*found, strict=True) if found else ((), ()), (np.int64, np.uint64), strict=True))
        asked = Asked(h)
        code, times = np.unique(asked.find(h) * len(rows) + row, return_counts=True)
        begin = np.searchsorted(code, np.arange(len(asked.hashes) + 1) * len(rows))
        return Items([i for i, _ in rows], begin, code % max(1, len(rows)), times), asked


def _impact(tf: Column, n: Column, docs: int, words: int) -> Column:
    m = F.lit(100 - 75).cast("long") + F.call_function("div", F.lit(75 * docs).cast("long") * n, F.lit(max(1, words)).cast("long"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + 8 * m)


class Terms(NamedTuple):
    """Of each term: its weight, the least impact of tiers 0 and 1, and the highest impact below each tier."""

    weight: np.ndarray
    least: np.ndarray  # a row for each tier but the last
    residual: np.ndarray


def terms(impacts: DataFrame, docs: int, many: int) -> Terms:
    """From rows of (term, impact). What comes to the driver are STEPS rows at most for each asked term of a block."""
    step = LIMIT // STEPS
    bucket = F.least(F.floor(F.col("impact") / step).cast("int"), F.lit(STEPS - 1))
    rows = impacts.groupBy("term", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top")).toPandas()
    n, top = np.zeros((many, STEPS), np.int64), np.zeros((many, STEPS), np.int64)
    n[rows["term"], rows["bucket"]], top[rows["term"], rows["bucket"]] = rows["n"], rows["top"]
    df = n.sum(1)
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    above = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n  # postings in higher buckets
    below = [above >= share * docs for share in TIERS]  # buckets of lower tiers
    return Terms(weight, np.array([x.sum(1) * step for x in below]), np.array([np.where(x, top, 0).max(1) for x in below] + [np.zeros(many, np.int64)]))


def tiered(forward_rows: DataFrame, of: Terms) -> DataFrame:
    """(doc_id, t0, i0, t1, i1, t2, i2): a document's terms and impacts by tier; from rows of (doc_id, terms, impacts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, impact = (b.column(c).flatten().to_numpy() for c in ("terms", "impacts"))
            row = np.repeat(np.arange(b.num_rows), b.column("terms").value_lengths().to_numpy())
            tier = (impact < of.least[0][term]).astype(np.int64) + (impact < of.least[1][term])
            cols = [b.column("doc_id")]
            for t in range(3):
                mine = tier == t
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=b.num_rows))])
                cols += [_list(term[mine], offsets), _list(impact[mine], offsets)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"{c}{t}" for t in range(3) for c in "ti")])

    return forward_rows.select("doc_id", "terms", "impacts").mapInArrow(run, "doc_id long, " + ", ".join(f"{c}{t} array<int>" for t in range(3) for c in "ti"))


class Scorer:
    """Sums over postings for all pairs of a run of documents and the items that are still open."""

    def __init__(self, items: Items, of: Terms, tier: int, still: np.ndarray) -> None:
        mine = np.isin(items.item, still)
        term = np.repeat(np.arange(len(items.begin) - 1), np.diff(items.begin))[mine]
        self.begin = np.searchsorted(term, np.arange(len(items.begin)))
        self.item = np.searchsorted(still, items.item[mine])
        self.weight = (items.times[mine] * of.weight[term]).astype(np.float64)
        self.left = self.weight * of.residual[tier][term]
        self.unseen = np.bincount(self.item, self.left, len(still))  # what a document that was not seen can get at most
        self.many = len(still)

    def sums(self, term: np.ndarray, impact: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, residuals of the terms seen) as tables of documents by items."""
        score, seen = np.zeros(rows * self.many), np.zeros(rows * self.many)
        count = self.begin[term + 1] - self.begin[term]
        upto = np.cumsum(count)
        for a, b in _runs(upto, SCORED):
            n = count[a:b]
            at = np.arange(int(n.sum())) + np.repeat(self.begin[term[a:b]] - (np.cumsum(n) - n), n)
            cell = np.repeat(row[a:b], n) * self.many + self.item[at]
            low = int(cell.min()) if len(cell) else 0
            for out, what in ((score, self.weight[at] * np.repeat(impact[a:b], n)), (seen, self.left[at])):
                part = np.bincount(cell - low, what)
                out[low : low + len(part)] += part
        return score.reshape(rows, self.many), seen.reshape(rows, self.many)


def _runs(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of postings that meet about `most` entries of items together."""
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _postings(b: pa.RecordBatch, tiers: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, impact, row) of some tiers, by row."""
    lens = [b.column(f"t{t}").value_lengths().to_numpy() for t in tiers]
    row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in lens])
    order = np.argsort(row, kind="stable")
    term, impact = (np.concatenate([b.column(f"{c}{t}").flatten().to_numpy() for t in tiers])[order] for c in "ti")
    return term, impact.astype(np.float64), row[order]


def _best(score: np.ndarray, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The entries that are among the BEST of their items: highest first, then by document."""
    order = np.lexsort((doc, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < BEST]


FOUND = "item int, doc_id long, score long"


def _pass(index: DataFrame, scorer: Scorer, tier: int, marks: np.ndarray | None = None) -> DataFrame:
    """Rows of FOUND: the best lower bounds of each item in a run of documents; with marks, the best whole scores of those that reach them."""
    names = [f"{c}{t}" for t in range(3 if marks is not None else tier + 1) for c in "ti"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CELLS // max(1, scorer.many))
            for b in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                score, seen = scorer.sums(*_postings(b, range(tier + 1)), b.num_rows)
                if marks is None:
                    many = min(BEST, b.num_rows)
                    top = np.argpartition(score, b.num_rows - many, axis=0)[b.num_rows - many :]
                    row, item = top.ravel(), np.tile(np.arange(scorer.many), many)
                    row, item = row[score[row, item] > 0], item[score[row, item] > 0]
                else:
                    row, item = np.nonzero((score > 0) & (score + scorer.unseen - seen >= marks))
                    short = np.unique(row[seen[row, item] < scorer.unseen[item]])
                    if len(short) and tier < 2:
                        part = b.take(pa.array(short))
                        score[short] += scorer.sums(*_postings(part, range(tier + 1, 3)), len(short))[0]
                doc = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = np.where(doc, np.iinfo(np.int64).max, b.column("doc_id").fill_null(0).to_numpy())
                kept = _best(score[row, item], item, ids[row])
                row, item = row[kept], item[kept]
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), b.column("doc_id").take(pa.array(row)), pa.array(score[row, item].astype(np.int64))], ["item", "doc_id", "score"])

    found = index.select("doc_id", *names).mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= BEST)


def _block(spark: SparkSession, scratch: Scratch, docs: DataFrame, rows: list[tuple[int | None, str | None]]) -> list[DataFrame]:
    items, asked = Items.of(rows)
    if not len(asked.hashes):
        return []
    fwd = scratch.keep(forward(docs, asked), "forward")
    size = fwd.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words")).first()
    n, words = size["docs"], size["words"] or 0
    impact = F.zip_with("tfs", F.array_repeat("n", F.size("tfs")), lambda tf, k: _impact(tf.cast("long"), k, n, words).cast("int"))
    impacts = fwd.select("doc_id", "terms", impact.alias("impacts"))
    every = impacts.select(F.explode(F.arrays_zip("terms", "impacts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.impacts").alias("impact"))
    of = terms(every, n, len(asked.hashes))
    index = scratch.keep(tiered(impacts, of), "index")
    scratch.drop(fwd)
    out, still = [], np.unique(items.item)
    for tier in range(3):
        scorer = Scorer(items, of, tier, still)
        bounds = _pass(index, scorer, tier).where(F.col("rank") == BEST).select("item", "score").toPandas()
        marks = np.zeros(len(still))
        marks[bounds["item"]] = bounds["score"]
        proven = (scorer.unseen < marks) | (scorer.unseen == 0)
        if proven.any():
            done = still[proven]
            names = spark.createDataFrame([(k, items.ids[i]) for k, i in enumerate(done.tolist())], "item int, item_id long")
            found = _pass(index, Scorer(items, of, tier, done), tier, marks[proven])
            # one row for each item of the block
            out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", F.lit(tier).alias("tier")))
        still = still[~proven]
        if not len(still):
            break
    return out


def search(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score, tier): the BEST documents of (doc_id, text) for each of (item_id, text), and the tier that proved it."""
    scratch = Scratch(spark, "lexical")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    out: list[DataFrame] = []
    block: list[tuple[int | None, str | None]] = []
    for row in asked.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == ITEMS:
            out += _block(spark, scratch, docs, block)
            block = []
    if block:
        out += _block(spark, scratch, docs, block)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE = """
with words as (
  select doc_id, row_number() over () as no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t
  from documents),
asked as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from benchmark) group by item_id, term),
size as (select count(*) filter (len(t) > 0) as docs, sum(len(t))::bigint as all_terms from words),
found as (
  select no, doc_id, n, term, count(*) as tf from (select no, doc_id, len(t) as n, unnest(t) as term from words) group by no, doc_id, n, term),
held as (select f.*, 100 - 75 + ((75 * f.n * s.docs) // s.all_terms) as m, s.docs from found f, size s where f.term in (select term from asked)),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from held group by term),
scored as (
  select a.item_id, h.no, h.doc_id, sum(a.q * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * h.m)))::bigint as score
  from held h join weights w on w.term = h.term join asked a on a.term = h.term group by a.item_id, h.no, h.doc_id)
select item_id, rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from scored where score > 0)
where rank <= 10
"""
