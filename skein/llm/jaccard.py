"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words; two are linked if their sets' Jaccard similarity is 0.8
or more. Every set is sampled by min-hashing: SLOTS tokens, slot by slot, so that two sets agree in a
slot with a probability equal to their similarity. The join splits all sets on sampled shared tokens:
a set follows a path if it has the token chosen there. In a crowded bucket the sets close to the
bucket's first set are joined to it and leave; the others are split again on the tokens chosen for that
path, until no bucket is crowded; small buckets are compared by brute force. RUNS first splits are made,
after which a linked pair has met in a bucket with the target recall.

What meets is joined to candidate groups (distributed components, no pairs are emitted), and within
each candidate group every two sets are compared exactly, in tiles of bounded size, so a group of any
size is shared out over tasks. Copies, texts of the same words, stand as one text.

Defined results: null and empty texts have no shingles and are classes of their own; a text of one to
four words has one shingle, of all of them; a null id stays null; rows alike are copies of each other;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import KEY, Scratch, ceil_log, row_key, table
from skein.llm.components import connected_components
from skein.llm.hashing import in_slices, mix, shingles

#: Similarity as a fraction, and words in a shingle.
LEAST = (4, 5)
SIZE = 5
#: Sampled tokens of a set, and the share of linked pairs that may stay unmet.
SLOTS, MISS = 64, 1e-5
RUNS = ceil_log(MISS, LEAST[0] / LEAST[1])
#: Sets that a bucket may hold to be compared by brute force, and children of a path.
SMALL, FORKS = 1024, 2
#: Slots in which two sets agree: so many join them to one candidate group, and so many make one stand for the other.
#: Sets linked to a set that agrees with a third in SAME slots have a similarity of 0.5 or more to the third,
#: and so agree with it in NEAR slots; the gap allows for the sampling.
SAME, NEAR = 46, 24
#: A class's internal name: the number of one of its texts, since ids may be null or repeat.
CLASS = "_sk_class"
#: Words and sets of the texts in a tile's side, about.
TILE, SETS = 150_000, 1024
_SEEDS = np.random.default_rng(64).integers(0, 2**63, SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _sampled(docs: DataFrame) -> DataFrame:
    """Per row: hashes of its word sequence, its number of words and the samples of its set; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, part in in_slices(b.column("_sk_text").to_pylist()):
                s = shingles(part, SIZE)
                some = np.flatnonzero(s.counts)
                sketch = np.zeros((len(part), SLOTS), np.uint32)
                if len(some):
                    starts = (np.cumsum(s.counts) - s.counts)[some]
                    for k, seed in enumerate(_SEEDS):
                        sketch[some, k] = np.minimum.reduceat(((s.hashes * seed) >> np.uint64(32)).astype(np.uint32), starts)
                twin = mix(s.order ^ np.uint64(0x5BD1E995))
                if len(some):
                    twin[some] ^= np.add.reduceat(s.hashes, starts)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).slice(begin, len(part)) for n in (KEY, "doc_id")), pa.array(s.order.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(s.words), pa.FixedSizeListArray.from_arrays(pa.array(sketch.view(np.int32).ravel()), SLOTS).cast(pa.list_(pa.int32()))],
                    [KEY, "doc_id", "f1", "f2", "n_words", "sketch"],
                )

    return docs.mapInArrow(run, f"{KEY} binary, doc_id long, f1 long, f2 long, n_words long, sketch array<int>")


def _agree(a, b):  # noqa: ANN001, ANN202
    """In how many slots two samples agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _met_in_small(rows: DataFrame) -> DataFrame:
    """(u, v) from buckets: a row is joined to the groups of rows before it that it is near to.

    A row that is much like one before it is stood for by that one; the edges of a bucket are a forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, stand, joined, sketches, size = None, [], [], np.zeros((0, SLOTS), np.int32), 0

        def root(k: int) -> int:
            while joined[k] != k:
                joined[k] = joined[joined[k]]
                k = joined[k]
            return k

        for b in batches:
            u, v = [], []
            sketch = b.column("sketch").flatten().to_numpy().reshape(-1, SLOTS)
            for i, (key, node) in enumerate(zip(b.column("bucket").to_pylist(), b.column("node").to_pylist(), strict=True)):
                if key != bucket:
                    bucket, stand, joined, size = key, [], [], 0
                alike = (sketches[:size] == sketch[i]).sum(1)
                near = np.flatnonzero(alike >= NEAR).tolist()
                own = None
                for k in near:  # one edge for each group of standing sets that it is near to: a forest
                    if own is None or root(k) != own:
                        u.append(node), v.append(stand[k])
                        if own is not None:
                            joined[root(k)] = own
                        own = root(k)
                if not (alike >= SAME).any():
                    if size == len(sketches):
                        sketches = np.concatenate([sketches, np.zeros((max(64, size), SLOTS), np.int32)])
                    sketches[size] = sketch[i]
                    stand.append(node)
                    joined.append(size if own is None else own)
                    size += 1
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.select("bucket", "node", "sketch").mapInArrow(run, "u long, v long")


def _meetings(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """(u, v): texts that met in a bucket and are near, or near to the same third."""
    found: list[DataFrame] = []
    sketches = texts.select("node", "sketch")
    first = texts.select("node", F.explode(F.array(*[F.xxhash64(F.lit(k), F.element_at("sketch", k + 1)) for k in range(RUNS)])).alias("bucket"))
    # most buckets hold one text: the others are found before any sample is moved, and written, so that Spark can split the join of a crowded one
    shared = scratch.keep(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("head")).where("count > 1"), "shared")
    rows = scratch.keep(first.join(shared, "bucket").join(sketches, "node"), "met")
    while True:
        small = rows.where(F.col("count") <= SMALL)
        found.append(scratch.keep(_met_in_small(small.repartition("bucket").sortWithinPartitions("bucket", "node")), "edges"))
        crowded = rows.where(F.col("count") > SMALL)
        if crowded.isEmpty():
            return reduce(DataFrame.union, found)
        heads = crowded.where("node = head").select("bucket", F.col("sketch").alias("_head"))  # one row per bucket
        alike = _agree("sketch", "_head")
        beside = scratch.keep(crowded.join(heads, "bucket").select("bucket", "node", "sketch", "head", alike.alias("alike")), "crowded")
        found.append(beside.where((F.col("alike") >= NEAR) & (F.col("node") != F.col("head"))).select(F.col("node").alias("u"), F.col("head").alias("v")))
        slot = [F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(SLOTS)).cast("int") + 1 for k in range(FORKS)]
        children = F.array_distinct(F.array(*[F.xxhash64("bucket", s, F.element_at("sketch", s)) for s in slot]))
        first = beside.where(F.col("alike") < SAME).select("node", "sketch", F.explode(children).alias("bucket"))
        shared = scratch.keep(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("head")).where("count > 1"), "shared")
        rows = scratch.keep(first.join(shared, "bucket"), "met")


def _links(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Whether the Jaccard similarity of each set of a with each of b (of a, if None) is LEAST or more; sets are sorted distinct hashes."""
    both = a if b is None else [*a, *b]
    sizes = np.array([len(x) for x in both], np.int64)
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], value[1:] != value[:-1]])
    token = np.cumsum(fresh) - 1
    often = np.bincount(token)[token] > 1  # a token of one set is in no intersection
    owner = owner[often]
    token = np.cumsum(np.concatenate([[True], np.diff(token[often]) > 0])) - 1 if len(owner) else owner
    m = len(a)
    n = len(both) - (0 if b is None else m)
    common = np.zeros((m, n), np.float32)
    width = 4096
    cuts = np.searchsorted(token, np.arange(0, (int(token[-1]) if len(token) else -1) + width + 1, width))
    for x, y in itertools.pairwise(cuts.tolist()):
        if x < y:
            mat = np.zeros((len(both), width), np.float32)
            mat[owner[x:y], token[x:y] % width] = 1
            common += mat[:m] @ (mat if b is None else mat[m:]).T
    left, right = sizes[:m, None], (sizes if b is None else sizes[m:])[None, :]
    out = LEAST[1] * common >= LEAST[0] * (left + right - common)
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _compared(rows: DataFrame) -> DataFrame:
    """From texts sorted by tile: (node, links to other texts, to documents, the smallest node it hangs together with here)."""
    schema = "node long, texts long, docs long, root long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile: tuple | None = None
        held: list[tuple] = []

        def out() -> Iterator[pd.DataFrame]:
            if not held:
                return
            block, node, copies, sets = (list(x) for x in zip(*held, strict=True))
            node, copies, block = np.array(node), np.array(copies, float), np.array(block)
            left = np.flatnonzero(block == tile[1])
            right = left if tile[1] == tile[2] else np.flatnonzero(block == tile[2])
            if not len(left) or not len(right) or right is left and len(left) < 2:
                return
            link = _links([sets[k] for k in left], None if right is left else [sets[k] for k in right])
            whole = np.zeros((len(node), len(node)), bool)
            whole[np.ix_(left, right)] |= link
            if right is not left:
                whole[np.ix_(right, left)] |= link.T
            root = np.arange(len(node))
            while True:  # the smallest number within reach, by doubling
                near = np.where(whole, root[None, :], len(node)).min(1)
                new = np.minimum(root, near)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            by_size = np.argsort(node, kind="stable")
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, root[by_size], node[by_size])
            n = whole.sum(1)
            yield pd.DataFrame({"node": node, "texts": n, "docs": (whole @ copies).astype(np.int64), "root": least[root]})[n > 0]

        for b in batches:
            where = list(zip(b["component"], b["ti"], b["tj"], strict=True))
            for begin, part in in_slices(b["text"].tolist()):
                s = shingles(part, SIZE)
                ends = np.cumsum(s.counts)
                for k in range(len(part)):
                    i = begin + k
                    if where[i] != tile:
                        yield from out()
                        tile, held = where[i], []
                    node = b["node"].iat[i]
                    if held and held[-1][1] == node and held[-1][0] == b["block"].iat[i]:
                        continue  # a row alike
                    held.append((b["block"].iat[i], node, b["copies"].iat[i], np.unique(s.hashes[ends[k] - s.counts[k] : ends[k]])))
        yield from out()

    return rows.select("component", "ti", "tj", "block", "node", "copies", "text").mapInPandas(run, schema)


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies) and internal columns of every row.

    class_id: the smallest id among the documents that links hold together; n_links: documents of
    similarity 0.8 or more to this one, copies included; n_text_links: the same for different texts;
    n_copies: documents of the same words, this one included (0 without words).
    """
    scratch = Scratch(spark, "jaccard")
    keyed = docs.select(row_key(id_col, text_col).alias(KEY), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_sk_text"))
    rows = scratch.keep(_sampled(keyed), "samples")
    worded = rows.where("n_words > 0")
    texts = worded.groupBy("f1", "f2").agg(
        F.min(KEY).alias("one"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n_words").alias("n_words"), F.min("sketch").alias("sketch")
    )
    # the number is written with the text, and stays the same whatever is lost
    texts = scratch.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    groups = scratch.keep(connected_components(spark, _meetings(scratch, texts)), "groups")
    member = texts.select("node", "one", "copies", "n_words").join(groups, "node")
    sizes = member.groupBy("component").agg(F.ceil(F.greatest(F.sum("n_words") / TILE, F.count(F.lit(1)) / SETS)).cast("int").alias("blocks"))
    placed = scratch.keep(member.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    # the same plan at every size: neither side is broadcast, however small it is
    whole = placed.drop("n_words").hint("merge").join(keyed.select(F.col(KEY).alias("one"), F.col("_sk_text").alias("text")), "one").drop("one")
    other = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = other.withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    tiled = tiled.repartition("component", "ti", "tj").sortWithinPartitions("component", "ti", "tj", "block", "node")
    tiles = scratch.keep(_compared(tiled), "tiles")
    split = tiles.join(placed.where("blocks > 1").select("node"), "node", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    joined = connected_components(spark, split).select("node", F.col("component").alias("joined"))
    counted = tiles.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"), F.min("root").alias("root"))
    linked = counted.join(joined, "node", "left")
    none = F.lit(0).cast("long")
    found = texts.join(linked, "node", "left").select(
        "f1", "f2", "copies", "least", F.coalesce("joined", "root").alias("_sk_root"), F.col("node").alias("_sk_node"), F.coalesce("texts", none).alias("texts"), F.coalesce("docs", none).alias("docs")
    )
    found = scratch.keep(found, "found")
    first = found.where("_sk_root is not null").groupBy("_sk_root").agg(F.min("least").alias("first"))
    named = found.join(first, "_sk_root", "left").select("f1", "f2", "copies", "texts", "docs", F.when(F.col("_sk_root").isNotNull(), F.col("first")).otherwise(F.col("least")).alias("class_id"), F.coalesce("_sk_root", "_sk_node").alias(CLASS))
    out = rows.select(KEY, "doc_id", "f1", "f2", "n_words").join(named, ["f1", "f2"], "left")
    some = F.col("n_words") > 0
    return out.select(
        "doc_id",
        F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.col("docs") + F.col("copies") - 1).otherwise(none).alias("n_links"),
        F.when(some, F.col("texts")).otherwise(none).alias("n_text_links"),
        F.when(some, F.col("copies")).otherwise(none).alias("n_copies"),
        KEY,
        CLASS,
        F.col("n_words").alias("_sk_words"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, table(spark, sf_dir, "documents")).drop(KEY, CLASS, "_sk_words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest id; all rows without words stay, as they are."""
    del sf_dir
    scratch = Scratch(spark, "jaccard-stage")
    found = scratch.keep(classes(spark, docs), "classes")
    first = found.where("_sk_words > 0").groupBy(CLASS).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias(KEY))
    stay = scratch.keep(first.select(KEY, F.lit(True).alias("_sk_one")).union(found.where("_sk_words = 0").select(KEY, F.lit(False)).distinct()), "stay")
    out = docs.withColumn(KEY, row_key("doc_id", "text")).join(stay, KEY)
    if not found.where("_sk_words > 0").groupBy(KEY).count().where("count > 1").isEmpty():
        # rows alike in id and text: of those with words one stays
        out = out.where("_sk_one").dropDuplicates([KEY]).union(out.where("not _sk_one"))
    return out.select(*[f"`{c}`" for c in docs.columns])
