"""The prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation's path is one unit for each turn: 16 bytes of the digest of (role, text) and 4 of its number of words.
Paths alike are put together first. Tasks sort theirs into runs, and every path of a run carries its LCP, the number of
turns that it shares with the one before. Runs are dealt out by ranges of paths, and a task merges the pieces of the
runs that lie in its range by a tree of losers: heads are compared by their LCPs with the path that came out last, and
turns are only read from there on when these are equal. The merged stream comes with LCPs again, so the trie's nodes are
the entries of a stack that holds the open path: a node is finished when the next path leaves it.

A node that spans ranges comes out of each in part. A range knows the last path before it and the first after it: a node
that is shared with the path before is counted by the range it began in, and a path that the next one goes on from is no
leaf. So parts just add up, and only they are grouped.

A conversation's path is one row, 20 bytes for each turn, and its nodes are on the stack of one task. Ranges are small
however many conversations are alike or begin alike. The ids of a node's ends are sorted by ranges and put into pieces
of text, which then run through one hash.

Defined results: null role or text is empty; rows without a conv_id belong to no conversation and are left out; a null
turn comes first, and turns of one number are ordered by their digests; a table without conversations has no nodes, not
even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, Scratch, table

#: Bytes of a turn's digest, and of a unit with its number of words.
DIGEST, UNIT = 16, 20
#: Conversations that share the turns of their first, and one more than the most turns that they share.
GROUP, SHARED = 20, 4
#: Bytes of paths of a run and of a range, and characters of a piece of ids.
RUN, RANGE, PIECE = 32_000_000, 8_000_000, 60_000
#: Parents with more than a share of 1/HOT of all nodes as children are joined apart; there are fewer than HOT.
HOT = 1000
ROOT = bytes(DIGEST)


def _unit() -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 2 * (UNIT - DIGEST), "0")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, units): each conversation's turns, the first few taken from the first conversation of its group of 20."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _unit().alias("unit"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "unit"))).alias("own"))
    own = own.select("conv_id", F.col("own.unit").alias("own"))
    first = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_group"), F.slice("own", 1, SHARED - 1).alias("first"))
    both = own.withColumn("_group", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "_group", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    begun = F.coalesce(F.slice("first", F.lit(1), h), F.array().cast("array<binary>"))
    return both.select("conv_id", F.concat(begun, F.slice("own", h + 1, F.size("own"))).alias("units"))


def paths(units: DataFrame) -> DataFrame:
    """(conv_id, path, key) of (conv_id, units). A node's key is the digest of its parent's key and its own unit."""
    path = F.unhex(F.array_join(F.transform("units", F.hex), ""))
    key = F.aggregate("units", F.lit(ROOT), lambda k, u: F.unhex(F.md5(F.concat(k, u))))
    return units.select("conv_id", path.alias("path"), key.alias("key"))


def common(a: bytes, b: bytes, begin: int = 0) -> int:
    """Turns that two paths share, if they share the first `begin`."""
    at, end = begin * UNIT, min(len(a), len(b))
    while at < end and a[at : at + UNIT] == b[at : at + UNIT]:
        at += UNIT
    return at // UNIT


class Item(NamedTuple):
    lcp: int  # with the path before it in its run, or in the merged stream
    path: bytes
    conv: int
    n: int


RUNS = "run string, at long, lcp int, path binary, conv_id long, n long"


def sorted_runs(distinct: DataFrame, size: int | None = None) -> DataFrame:
    """Runs of (path, conv_id, n): sorted, each path with its LCP."""
    most = size or RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[bytes, int, int]] = []
        bytes_held, made, part = 0, 0, TaskContext.get().partitionId()

        def sorted_run() -> pa.RecordBatch:
            held.sort()
            lcp = [0, *(common(a[0], b[0]) for a, b in zip(held, held[1:], strict=False))]
            name = f"{part:08d}-{made:08d}"
            p, c, n = zip(*held, strict=True)
            cols = [[name] * len(held), list(range(len(held))), lcp, list(p), list(c), list(n)]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["run", "at", "lcp", "path", "conv_id", "n"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "conv_id", "n")), strict=True):
                held.append(row)
                bytes_held += len(row[0]) + UNIT
                if bytes_held > most:
                    yield sorted_run()
                    held, bytes_held, made = [], 0, made + 1
        if held:
            yield sorted_run()

    return distinct.select("path", "conv_id", "n").mapInArrow(run, RUNS)


def merged(runs: list[list[Item]]) -> Iterator[Item]:
    """The items of sorted runs in order, with LCPs of the merged stream. The first item's LCP is 0."""
    heads, at, lcp = [r[0].path if r else None for r in runs], [0] * len(runs), [0] * len(runs)
    width = 1 << max(0, len(runs) - 1).bit_length()
    heads += [None] * (width - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser). Both heads come after the path that came out last; lcp is what they share with it."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        same = common(heads[a], heads[b], lcp[a])
        x, y = heads[a][same * UNIT : same * UNIT + UNIT], heads[b][same * UNIT : same * UNIT + UNIT]
        first, second = (a, b) if x <= y else (b, a)
        lcp[second] = same
        return first, second

    lcp += [0] * (width - len(runs))
    losers, winners = [0] * width, [0] * width + list(range(width))
    for k in range(width - 1, 0, -1):
        winners[k], losers[k] = play(winners[2 * k], winners[2 * k + 1])
    top = winners[1] if width > 1 else 0
    while runs and heads[top] is not None:
        run, k = runs[top], at[top]
        yield run[k]._replace(lcp=lcp[top])
        at[top] = k + 1
        heads[top] = run[k + 1].path if k + 1 < len(run) else None
        lcp[top] = run[k + 1].lcp if k + 1 < len(run) else 0
        node = (top + width) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


NODES = "key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, told long, once long, whole boolean"
_KINDS = (pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.bool_())


class Open:
    """A node of the open path."""

    __slots__ = ("key", "words", "conv", "n", "children", "leaves", "told", "once", "own")

    def __init__(self, key: bytes, words: int, own: bool) -> None:
        self.key, self.words, self.own = key, words, own  # own: the node begins in this range
        self.conv, self.n, self.children, self.leaves, self.told, self.once = None, 0, 0, 0, 0, 0


def finished(stream: Iterator[Item], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Rows of nodes from a merged stream; before and after are the paths next to it, null at the ends of all paths.

    told: words times conversations of the node and all below it; once: words of those of them that begin here.
    """
    stack: list[Open] = []
    bound, path = 0, b""  # nodes down to this depth are shared with the path before

    def close(depth: int, upto: int) -> Iterator[tuple]:
        while len(stack) > depth:
            x = stack.pop()
            d = len(stack)
            x.told += x.n * x.words
            x.once += x.words if x.own else 0
            yield x.key, stack[-1].key if stack else None, d, x.conv, x.n, x.children, x.leaves, x.told, x.once, x.own and d > upto
            if stack:
                up = stack[-1]
                up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
                up.n += x.n
                up.children += x.own
                up.leaves += x.leaves
                up.told += x.told
                up.once += x.once

    last: Item | None = None
    for now in stream:
        if last is None:
            bound = -1 if before is None else common(before, now.path)
            stack.append(Open(ROOT, 0, bound < 0))
        else:
            if now.lcp * UNIT < len(last.path):
                stack[-1].leaves += 1  # the next path does not go on from the last one
            yield from close(now.lcp + 1, -1)
        path = now.path
        for d in range(len(stack), len(path) // UNIT + 1):
            unit = path[(d - 1) * UNIT : d * UNIT]
            own = last is not None or d > bound
            stack.append(Open(hashlib.md5(stack[-1].key + unit).digest(), int.from_bytes(unit[DIGEST:], "big"), own))
        top = stack[-1]
        top.conv = now.conv if top.conv is None else min(top.conv, now.conv)
        top.n += now.n
        last = now
    if last is not None:
        shared = -1 if after is None else common(last.path, after)
        if shared * UNIT < len(last.path) or after is None:
            stack[-1].leaves += 1
        yield from close(0, shared)


def nodes(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """Nodes of (path, conv_id, n), rows of NODES; a node that spans ranges comes in parts that add up."""
    spark = scratch.spark
    runs = scratch.keep(sorted_runs(distinct), "runs")
    size = runs.agg(F.sum(F.octet_length("path") + UNIT).alias("size")).first()["size"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    # the bounds of ranges are sampled, so what lies in a range is written once
    ranged = scratch.keep(runs.repartitionByRange(n, "path").withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    w = Window.orderBy("range")  # one row for each range
    ends = ends.select("range", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    beside = ends.select("range", F.explode(F.array(F.struct(F.lit(-2).alias("at"), F.col("before").alias("path")), F.struct(F.lit(-1).alias("at"), F.col("after").alias("path")))).alias("x"))
    beside = beside.select(F.lit("").alias("run"), F.col("x.at").cast("long").alias("at"), F.lit(0).alias("lcp"), "x.path", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"), "range")
    rows = ranged.select(*beside.columns).unionByName(beside).repartition(n, "range").sortWithinPartitions("range", "run", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[tuple[list, dict[str, list[Item]]]]:
            now, beside, held = None, [None, None], {}
            for b in batches:
                for r, name, at, *item in zip(*(b.column(c).to_pylist() for c in ("range", "run", "at", "lcp", "path", "conv_id", "n")), strict=True):
                    if r != now:
                        if held:
                            yield beside, held
                        now, beside, held = r, [None, None], {}
                    if at < 0:
                        beside[at + 2] = item[1]
                    else:
                        held.setdefault(name, []).append(Item(*item))
            if held:
                yield beside, held

        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], [x.split()[0] for x in NODES.split(", ")])
        for (before, after), held in ranges():
            pieces = [[x[0]._replace(lcp=0), *x[1:]] for x in held.values()]
            held.clear()
            for row in finished(merged(pieces), before, after):
                out.append(row)
                if len(out) == 10_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return scratch.keep(rows.mapInArrow(run, NODES), "nodes")


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the digest of the ids of each key, ascending and joined by commas."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, text, size = None, None, [], 0
        for b in batches:
            out: list[tuple] = []
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key or size > PIECE:
                    if text:
                        out.append((key, first, ",".join(text)))
                    key, first, text, size = k, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])
        if text:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out: list[tuple] = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    pieces = rows.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(told, "key binary, first long, ids string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, units), one row each."""
    scratch = Scratch(spark, "trie")
    keyed = scratch.keep(paths(rows), "paths")
    found = nodes(scratch, keyed.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "told", "once")]
    parts = found.where("not whole").groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
    every = scratch.keep(found.where("whole").select(*parts.columns).unionByName(parts).join(ends(keyed), "key", "left"), "trie")
    up = every.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HOT > every.count()).alias("hot"))
    hot = F.broadcast(up.where("hot").select("parent", F.col("parent_conv_id").alias("_hot")))
    rest = every.join(hot, "parent", "left")
    known = rest.where("_hot is not null or parent is null").withColumnRenamed("_hot", "parent_conv_id")
    others = rest.where("_hot is null and parent is not null").drop("_hot").join(up.where("not hot").drop("hot"), "parent", "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return known.unionByName(others).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *counts, (F.col("told") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, rebuilt(table(spark, sf_dir, "conversations")))


#: DuckDB has no crc32, so the checksum of the decimal id is reduced bit by bit.
ORACLE = """
with turns as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
         row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 20 as first,
    xor(4294967295, list_reduce([4294967295::bigint] || flatten([[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv_id::varchar, '')]),
      lambda a, b: case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) % 4 as h
  from (select distinct conv_id from turns)),
placed as (
  select c.conv_id, 0 as own, t.k, t.r, t.x from convs c join turns t on t.conv_id = c.first and t.k <= c.h
  union all
  select c.conv_id, 1, t.k, t.r, t.x from convs c join turns t on t.conv_id = c.conv_id and t.k > c.h),
numbered as (
  select conv_id, row_number() over (partition by conv_id order by own, k) as d, strlen(r) || ':' || r || x as turn,
         len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words
  from placed),
on_path as (
  select conv_id, d, words, md5(string_agg(md5(turn), '') over (partition by conv_id order by d)) as key from numbered
  union all
  select conv_id, 0, 0, '' from convs),
nodes as (select key, d, min(conv_id) as conv_id, count(*) as n, min(words) as words from on_path group by key, d),
above as (select v.key, a.key as up, a.d as at from nodes v join on_path a on a.conv_id = v.conv_id and a.d <= v.d),
family as (select a.key, a.up as parent from above a join nodes v on v.key = a.key where a.at = v.d - 1),
childless as (select key from nodes where key not in (select parent from family)),
below as (
  select a.up as key, sum((v.n - 1) * v.words)::bigint as saved, sum((c.key is not null)::int)::bigint as leaves
  from above a join nodes v on v.key = a.key left join childless c on c.key = a.key group by a.up),
kids as (select parent as key, count(*) as n from family group by parent),
last as (select conv_id, arg_max(key, d) as key from on_path group by conv_id),
ended as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from last group by key)
select v.conv_id, v.d as depth, p.conv_id as parent_conv_id, v.n as n_convs, coalesce(k.n, 0) as n_children, b.leaves as n_leaves, b.saved as saved_tokens,
       coalesce(e.ends, sha256('')) as ends_sha256
from nodes v join below b on b.key = v.key left join kids k on k.key = v.key left join ended e on e.key = v.key
left join family f on f.key = v.key left join nodes p on p.key = f.parent
"""
