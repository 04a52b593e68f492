"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes every norm 1, which
turns the largest inner product into the smallest Euclidean distance. Each of TABLES tables cuts space
into cells by a few random projections (p-stable for p = 2). A query visits its own cell and cells beside
it in the order of their estimated success, that is of its squared distance to the walls between, and
all candidates met in any table are ranked by their exact inner product. Sets of steps to cells beside
come from a list in the order of their expected cost, made by shifting and expanding sets from the
cheapest on, so no more of them are made than may be visited, however many projections there are.

How many projections a table has and how many cells a query visits is fitted for each vector length on a
sample of SAMPLE rows at most: of the numbers of projections, which may grow with the table without end,
the one that costs least among those that reach at least AIM of the true neighbours there; all rows are
indexed. Queries meet their own cells in FIRST tables first; what they have then as the last of their
lists goes with them to all other cells, which answer only with what is better. A query that meets fewer
candidates than it could list, min(k, other rows of its length), is ranked exactly against all rows
instead, BLOCK such queries in one pass over the rows. Rows of the same vector are one entry with its
smallest ids, all that a list of k neighbours can show of them. Cells with more than CHUNK entries are
dealt in chunks, and a query meets every chunk.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part; ties go to the smaller id; rows alike in id and vector are one; vectors of another length than
the query's are no candidates; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Scratch, table

TABLES, FIRST = 6, 2
WIDTH = 1.5
SAMPLE, SAMPLE_QUERIES, AIM = 2000, 200, 0.98
#: Sets of steps in the list, and the work of one visit in entries compared.
PROBES, VISIT = 2048, 64
CHUNK = 512
#: Queries ranked exactly in one pass over all rows; more of them take more passes.
BLOCK = 1024
#: Levels over which the smallest ids of a repeated vector are found.
_LEVELS = (64, 8, 1)


@functools.cache
def planes(dim: int, tables: int, bits: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables * bits, dim + 1) and offsets; the same on every machine."""
    r = np.random.default_rng([20, dim, tables, bits])
    return r.standard_normal((tables * bits, dim + 1)), r.uniform(0, width, tables * bits)


@functools.cache
def sets(bits: int, most: int = PROBES) -> np.ndarray:
    """Sets of steps, sets x 2 bits, in the order of their expected cost, the empty one first.

    A step is named by its place among a query's 2 bits steps in the order of their cost; place j and place
    2 bits - 1 - j are the two ways along one projection, and never in one set.
    """
    near = [j * (j + 1) / (4 * (bits + 1) * (bits + 2)) for j in range(1, bits + 1)]
    cost = near + [1 - j / (bits + 1) + j * (j + 1) / (4 * (bits + 1) * (bits + 2)) for j in range(bits, 0, -1)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        now, chosen = heapq.heappop(heap)
        if not {2 * bits - 1 - j for j in chosen} & set(chosen):
            out.append(chosen)
        if (last := chosen[-1]) + 1 < 2 * bits:
            heapq.heappush(heap, (now - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (now + cost[last + 1], (*chosen, last + 1)))
    inside = np.zeros((len(out), 2 * bits), np.int8)
    for k, chosen in enumerate(out):
        inside[k, list(chosen)] = 1
    return inside


def lifted(vectors: np.ndarray, norm: float, query: bool) -> np.ndarray:
    x = vectors / norm
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
    if query:  # a query's length doesn't change its order of inner products
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    return np.hstack([x, rest[:, None]])


def cells(x: np.ndarray, tables: int, bits: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers, place inside the cell from 0 to 1), each rows x tables x bits."""
    a, b = planes(x.shape[1] - 1, tables, bits, width)
    at = (x @ a.T + b) / width
    cell = np.floor(at)
    return cell.astype(np.int64).reshape(len(x), tables, bits), (at - cell).reshape(len(x), tables, bits)


def ordered(inside: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps in the order of their cost, sets in the order of theirs), each rows x tables x many. Steps below `bits` go down."""
    cost = np.concatenate([inside**2, (1 - inside) ** 2], 2)
    steps = cost.argsort(2, kind="stable")
    whole = np.take_along_axis(cost, steps, 2) @ sets(bits).T.astype(float)
    return steps, whole.argsort(2, kind="stable")


def visited(cell: np.ndarray, inside: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Cells that a query visits, rows x tables x probes x bits, its own first."""
    steps, order = ordered(inside, bits)
    way = np.zeros((*steps.shape, bits), np.int8)
    r, t, j = np.ogrid[: steps.shape[0], : steps.shape[1], : steps.shape[2]]
    way[r, t, j, steps % bits] = np.where(steps < bits, -1, 1)
    return cell[:, :, None, :] + sets(bits)[order[:, :, :probes]] @ way


def names(cell: np.ndarray, dim: int) -> np.ndarray:
    """One long per cell (..., bits), the table's number included by the second axis from the left."""
    # the length is spread over all bits, so that a cell's number can't make up for it
    h = np.full(cell.shape[:-1], (0x9E3779B97F4A7C15 ^ dim) * 0xBF58476D1CE4E5B9 % 2**64, np.uint64)
    h += np.arange(cell.shape[1], dtype=np.uint64).reshape((1, -1) + (1,) * (cell.ndim - 3)) * np.uint64(0xD1B54A32D192ED03)
    for k in range(cell.shape[-1]):
        h = (h ^ cell[..., k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def ranks(cell: np.ndarray, inside: np.ndarray, other: np.ndarray, bits: int) -> np.ndarray:
    """As which of its visits each row of cell comes to each of its others (rows x others x tables x bits); the number of all if never."""
    steps, order = ordered(inside, bits)
    place, turn = steps.argsort(2), order.argsort(2)
    powers = 1 << np.arange(2 * bits, dtype=np.int64)
    names_ = sets(bits).astype(np.int64) @ powers
    by_name = names_.argsort()
    apart = other - cell[:, None]
    value = powers[place]  # rows x tables x steps
    name = ((apart == -1) * value[:, None, :, :bits] + (apart == 1) * value[:, None, :, bits:]).sum(-1)
    at = np.minimum(np.searchsorted(names_[by_name], name), len(names_) - 1)
    known = (names_[by_name][at] == name) & (np.abs(apart) <= 1).all(-1)
    r, t = np.ogrid[: len(cell), : cell.shape[1]]
    return np.where(known, turn[r[:, None], t[None], by_name[at]], len(names_))


def fitted(sample: np.ndarray, n: int, k: int, norm: float) -> tuple[int, int]:
    """(projections of a table, cells a query visits in it): the least work among what reaches AIM of the sample's neighbours that stand for the k nearest of n rows."""
    if len(sample) < 2:
        return 1, len(sets(1))
    q = sample[:SAMPLE_QUERIES]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / max(n, 1))))
    best = np.argpartition(-score, near - 1, axis=1)[:, :near]
    found: list[tuple[bool, float, int, int]] = []
    for bits in range(1, max(1, round(math.log2(max(n, 2) / 300) / 2)) + 1):
        mine, inside = cells(lifted(q, norm, True), TABLES, bits, WIDTH)
        theirs, _ = cells(lifted(sample, norm, False), TABLES, bits, WIDTH)
        rank = ranks(mine, inside, theirs[best], bits).min(-1).ravel()
        probes = int(min(len(sets(bits)), np.quantile(rank, AIM, method="higher") + 1))
        few = slice(0, 20)
        share = (ranks(mine[few], inside[few], np.broadcast_to(theirs, (len(q[few]), *theirs.shape)), bits) < probes).mean()
        found.append(((rank < probes).mean() < AIM, TABLES * (probes * VISIT + share * n), bits, probes))
    return min(found)[2:]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, _matrix(column.take(pa.array(rows)))


def _placed(df: DataFrame, norm: float, fits: dict[int, tuple[int, int]], query: bool) -> DataFrame:
    """df (id, vector) with the cells it is in, or visits, as an array of longs, and those of them that are its own in the FIRST tables; no shuffle.

    fits: (projections, probes) by vector length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                out: list[np.ndarray] = [np.zeros(0, np.int64)] * b.num_rows
                own = np.zeros((b.num_rows, FIRST), np.int64)
                for rows, m in _by_length(b.column("vector")):
                    bits, probes = fits[m.shape[1]]
                    cell, inside = cells(lifted(m, norm, query), TABLES, bits, WIDTH)
                    named = names(visited(cell, inside, bits, probes) if query else cell[:, :, None, :], m.shape[1])
                    own[rows] = named[:, :FIRST, 0]
                    for r, x in zip(rows, named.reshape(len(rows), -1), strict=True):
                        out[r] = x
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32)), pa.array(np.concatenate(v))) for v in (out, list(own))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), *lists], ["id", "vector", "cells", "own"])

    kept = df.select("id", "vector")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("cells", "own")]]))


#: A row for each query that a task met, with the best entries it found there.
_FOUND = "query long, entries array<long>, scores array<double>"


class _Best:
    """The best `keep` entries of each query so far, within one task."""

    def __init__(self, keep: int) -> None:
        self.keep, self.q, self.v, self.s, self.size = keep, [], [], [], 0

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        if not len(q):
            return
        self.q.append(q), self.v.append(v), self.s.append(s)
        self.size += len(q)
        if self.size > 1_000_000:
            self.pack()

    def pack(self) -> tuple[np.ndarray, ...]:
        if not self.q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, v, s = (np.concatenate(x) for x in (self.q, self.v, self.s))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        again = np.zeros(len(q), bool)
        again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
        q, v, s = q[~again], v[~again], s[~again]
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.keep
        self.q, self.v, self.s = [q[top]], [v[top]], [s[top]]
        self.size = int(top.sum())
        return self.q[0], self.v[0], self.s[0]

    def meet(self, who: np.ndarray, part: np.ndarray, have: np.ndarray, mat: np.ndarray, least: np.ndarray | None = None) -> None:
        """Adds the best of the entries (have, mat) for each of the queries (who, part), if not below `least`."""
        score = part @ mat.T
        n = min(self.keep, len(have))
        edge = np.full(len(part), -np.inf) if least is None else least
        if n < len(have):  # all that tie with the last one
            edge = np.maximum(edge, np.take_along_axis(score, np.argpartition(-score, n - 1, axis=1)[:, :n], 1).min(1))
        qi, vi = np.nonzero(score >= np.where(np.isfinite(edge), edge - 1e-9 * np.maximum(1, np.abs(edge)), edge)[:, None])
        self.add(who[qi], have[vi], (part[qi] * mat[vi]).sum(1))

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, v, s = self.pack()
        if not len(q):
            return
        first = np.append(np.flatnonzero(np.diff(q, prepend=q[0] - 1)), len(q))
        for z in range(0, len(first) - 1, 2000):
            cut = first[z : z + 2001]
            part = slice(cut[0], cut[-1])
            lists = [pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(x[part])) for x in (v, s)]
            yield pa.RecordBatch.from_arrays([pa.array(q[cut[:-1]]), *lists], ["query", "entries", "scores"])


def _met(rows: DataFrame, keep: int) -> DataFrame:
    """From entries and visiting queries sorted by cell: each query's best entries of this task's cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cell, ids, vectors = _Best(keep), None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column("cell").to_numpy(), b.column("chunk").to_numpy(zero_copy_only=False).astype(np.int64), b.column("is_query").to_numpy(zero_copy_only=False).astype(np.int64)])
            id_, column, least = b.column("id").to_numpy(), b.column("vector"), b.column("least").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0).any(0)) + 1, [b.num_rows]])
            for x, y in itertools.pairwise(cuts.tolist()):
                if cell != (here := tuple(key[:2, x])):
                    cell, ids, vectors = here, [], []
                m = _matrix(column.slice(x, y - x))
                if not key[2, x]:
                    ids.append(id_[x:y]), vectors.append(m)
                    continue
                if not ids:
                    continue
                have, mat = np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [have], [mat]
                for z in range(0, len(m), 1024):
                    best.meet(id_[x:y][z : z + 1024], m[z : z + 1024], have, mat, least[x:y][z : z + 1024])
        yield from best.rows()

    return rows.mapInArrow(run, _FOUND)


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """(query, entry, score): the best entries of each query in what all tasks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(keep)
        for b in batches:
            n = np.asarray(b.column("entries").value_lengths()).astype(np.int64)
            best.add(np.repeat(b.column("query").to_numpy(), n), b.column("entries").flatten().to_numpy(), b.column("scores").flatten().to_numpy())
        q, v, s = best.pack()
        for z in range(0, len(q), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[z : z + 20_000]) for x in (q, v, s)], ["query", "entry", "score"])

    return found.repartition("query").mapInArrow(run, "query long, entry long, score double")


def _exact(index: DataFrame, ids: np.ndarray, vectors: list[list[float]], keep: int) -> DataFrame:
    """The best entries of each task's rows for each of a block of queries; every row is compared with every query of its length."""
    lengths = np.array([len(x) for x in vectors])
    asked = {d: (ids[lengths == d], np.array([x for x in vectors if len(x) == d], float)) for d in set(lengths.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(keep)
        for b in batches:
            id_ = b.column("id").to_numpy()
            for rows, m in _by_length(b.column("vector")):
                if m.shape[1] in asked:
                    best.meet(*asked[m.shape[1]], id_[rows], m)
        yield from best.rows()

    return index.select("id", "vector").mapInArrow(run, _FOUND)


def _first(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("_sk_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_sk_rank") <= n).drop("_sk_rank")


def nearest(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product found, for each row that `queries` picks."""
    scratch = Scratch(spark, "neighbours")
    single = vectors.select(F.col(vector_col).alias("v")).schema["v"].dataType == T.ArrayType(T.FloatType())
    kind = "array<float>" if single else "array<double>"
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"), queries.alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = picked.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite & F.exists("vector", lambda x: x != 0))
    usable = usable.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")}).dropDuplicates(["id", "h1", "h2"])
    usable = scratch.keep(usable, "usable")
    norm, n = usable.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = usable.select("h1", "h2", "id").withColumn("level", F.lit(0))
    for m in _LEVELS:
        ids = _first(ids.withColumn("level", F.pmod(F.xxhash64("id"), F.lit(m))), ["h1", "h2", "level"], ["id"], k + 1)
    grouped = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = scratch.keep(grouped.withColumn("entry", F.element_at("ids", 1)).select("entry", "ids"), "entries")
    alike = usable.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    index = usable.join(alike, ["h1", "h2", "id"]).select("id", "vector")
    sizes = {r[0]: r[1] for r in usable.groupBy(F.size("vector")).count().collect()}  # a row for each vector length
    fits = {}
    for dim, many in sizes.items():
        sample = index.where(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
        fits[dim] = fitted(np.array([r[0] for r in sample], float), many, k, norm)
    placed = _placed(index, norm, fits, False)
    cells_of = placed.select("id", "vector", F.explode("cells").alias("cell"))
    full = cells_of.groupBy("cell").count().where(F.col("count") > CHUNK).select("cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    full = scratch.keep(full, "full")
    asked = usable.where("asks")
    visits = _placed(asked, norm, fits, True)

    def answers(entries_in: DataFrame, visits_to: DataFrame) -> DataFrame:
        """What queries meet: entries_in (cell, id, vector), visits_to (cell, id, vector, least)."""
        chunks = F.coalesce("chunks", F.lit(1))
        dealt = entries_in.join(full, "cell", "left").select("cell", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), F.lit(0).alias("is_query"), "id", "vector", F.lit(None).cast("double").alias("least"))
        come = visits_to.join(full, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("is_query"), "id", "vector", "least")
        together = dealt.union(come).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "is_query", "id")
        return scratch.keep(_merged(_met(together, k + 1), k + 1), "met")

    nothing = F.lit(float("-inf"))
    at_home = answers(placed.select(F.explode("own").alias("cell"), "id", "vector"), visits.select(F.explode("own").alias("cell"), "id", "vector", nothing.alias("least")))
    least = scratch.keep(at_home.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least")), "least")
    known = visits.join(least.withColumnRenamed("query", "id"), "id", "left").select(F.explode("cells").alias("cell"), "id", "vector", F.coalesce("least", nothing).alias("least"))
    ranked = scratch.keep(_listed(at_home.union(answers(cells_of.select("cell", "id", "vector"), known)), entries, k), "ranked")
    others = F.create_map(*[F.lit(x) for d, c in sizes.items() for x in (d, c - 1)])
    could = asked.select("id", F.size("vector").alias("dim")).distinct().groupBy(F.col("id").alias("query")).agg(F.sum(others[F.col("dim")]).alias("could"))
    got = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("got"))
    short = could.join(got, "query", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "could")).select("query")
    short = scratch.keep(short, "short")
    again = asked.join(short.withColumnRenamed("query", "id"), "id", "left_semi").select("id", "vector").toLocalIterator()
    path, met = scratch.path("exact"), False
    while block := list(itertools.islice(again, BLOCK)):
        _exact(index, np.array([r[0] for r in block], np.int64), [r[1] for r in block], k + 1).write.mode("append").parquet(path)
        met = True
    if met:
        exact = _listed(_merged(spark.read.schema(_FOUND).parquet(path), k + 1), entries, k)
        ranked = ranked.join(short, "query", "left_anti").select(exact.columns).union(exact)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _listed(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query, score, vec_id, rank): the k best rows behind the entries found."""
    best = _first(found.dropDuplicates(["query", "entry"]), ["query"], [F.desc("score"), "entry"], k + 1)
    shown = best.join(entries, "entry").select("query", "score", F.explode("ids").alias("vec_id")).where("query <> vec_id")
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
