"""Removal of repeated passages by a logarithmic family of suffix arrays.

Every string of SPAN bytes that starts at two places or more is removed at all of them. Only some
suffixes need be indexed: of the grams of GRAM bytes in a string of SPAN bytes the one with the least
hash (the leftmost of equals) is its anchor, so equal strings have equal anchors at equal offsets, and
neighbouring strings share theirs. The stretch of a document whose strings share an anchor is one entry
of the index, kept under the anchor's gram: about one entry for 85 bytes.

The documents come in BATCHES batches. A batch gets its own sorted array of entries, with the number of
times each occurs, and is merge-scanned with the arrays of the levels there are, which shows the grams
that occur twice or more; then levels of equal size merge, so n batches leave log n levels at most.
Entries that repeat as a whole are repeated passages. Where entries of one gram differ, which is where
passages begin and end, their bytes are fetched, and a suffix array over them (prefix doubling to SPAN
bytes) finds the strings that they share, byte by byte. A gram whose differing pieces hold more than
CROWD bytes is split first: its strings are dealt by their distance to the anchor into two halves, and
within a half by the bytes that all of its strings would share. Pieces that are alike in a half combine
to one, with their number, before the shuffle; halves that are still too large are split again, down to
single strings, of which all that are alike are one. So no task gets more than CROWD bytes of a gram,
however often it occurs, and nothing is left out.

Defined results: a null text is empty; texts shorter than SPAN lose nothing; a passage that overlaps
itself is removed whole; rows alike repeat each other; a null id stays null; an empty table gives no
rows; further columns pass through strip(), but for columns named like its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import KEY, Scratch, by_bytes, row_key, table
from skein.llm.hashing import Prefixes, mix

SPAN, GRAM = 200, 32
#: Batches of the query, each with a suffix array of its own.
BATCHES = 4
#: Bytes of differing pieces that a task may hold of one gram, and those after which it starts a new suffix array.
CROWD, PIECES = 3_000_000, 1_000_000
#: Bytes of text that a task fingerprints, cuts or returns at once; longer texts are fingerprinted in overlapping parts.
SLICE = 1_000_000


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Where the minimum of each run of `width` values is, the leftmost of equals."""
    at, have = np.arange(len(v), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = v[:-step], v[step:]
        at = np.where(right < left, at[step:], at[:-step])
        v = np.minimum(left, right)
        have += step
    return at


def stretches(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, strings, distance to the anchor, gram hash, stretch hash) of the stretches of the texts whose strings share an anchor."""
    lens = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(0, lens - span + 1)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 6
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(lens) - lens
    prefix = Prefixes(data)
    at = np.arange(len(data) - gram + 1)
    grams = prefix.of(at, at + gram)
    anchor = sliding_argmin(grams, span - gram + 1)
    p = _ranges(begins, windows)
    owner = np.repeat(np.arange(len(texts)), windows)
    a = anchor[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(first, len(p)))
    start, owner, a = p[first], owner[first], a[first].astype(np.int64)
    away = a - start
    # the anchor's distance is part of what makes two stretches the same
    whole = mix(prefix.of(start, start + n + span - 1) + mix(away.astype(np.uint64)))
    return owner, start - begins[owner], n, away, grams[a].view(np.int64), whole.view(np.int64)


def _parts(texts: list[str | None], span: int, most: int = SLICE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) of texts in runs of about `most` bytes; a longer text comes in parts that overlap by a string less a byte."""
    rows, offsets, held, size = [], [], [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for x in range(0, max(1, len(raw) - span + 1), most):
            part = raw[x : x + most + span - 1]
            if held and size + len(part) > most:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(k), offsets.append(x), held.append(part)
            size += len(part)
    if held:
        yield rows, offsets, held


def entries(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, start, n, r, m, h): the index entries of rows of (key, _sk_text); n strings from start, the first r before the anchor. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(KEY)
            for rows, offsets, part in _parts(b.column("_sk_text").to_pylist(), span):
                owner, start, n, r, m, h = stretches(part, span, gram)
                cols = [keys.take(pa.array(np.array(rows)[owner], pa.int64())), pa.array(start + np.array(offsets)[owner]), pa.array(n.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(m), pa.array(h)]
                yield pa.RecordBatch.from_arrays(cols, [KEY, "start", "n", "r", "m", "h"])

    return docs.select(KEY, "_sk_text").mapInArrow(run, f"{KEY} binary, start long, n int, r int, m long, h long")


class IndexFamily:
    """Arrays of entries in levels: a level holds 2**level batches."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame]] = []

    def _array(self, rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("m", "h").agg(F.sum("c").alias("c"))
        return self.scratch.keep(counted.sortWithinPartitions("m", "h"), "level")

    def _merge(self) -> None:
        """Equal levels merge as long as there are any, all of a run of them in one pass."""
        size, run = self.levels[-1][0], 1
        while run < len(self.levels) and self.levels[-1 - run][0] == size:
            size, run = size + 1, run + 1
        if run > 1:
            old, self.levels = [x for _, x in self.levels[-run:]], self.levels[:-run]
            merged = old[0]
            for x in old[1:]:
                merged = merged.union(x)
            self.levels.append((size, self._array(merged)))
            for x in old:
                self.scratch.drop(x)

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes a batch of entries; (m,) of the grams that it makes repeated or that repeat in it."""
        own = self._array(batch.select("m", "h", F.lit(1).cast("long").alias("c")))
        scan = own.select("m", "c", F.lit(1).alias("new"))
        for _, level in self.levels:
            scan = scan.union(level.select("m", "c", F.lit(0).alias("new")))
        found = scan.groupBy("m").agg(F.sum("c").alias("c"), F.max("new").alias("new")).where("c > 1 and new = 1").select("m")
        found = self.scratch.keep(found, "repeated")
        self.levels.append((0, own))
        self._merge()
        self.scratch.release()
        return found

    def array(self) -> DataFrame:
        """(m, h, c) of all that was added."""
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.union(level)
        return rows if len(self.levels) == 1 else rows.groupBy("m", "h").agg(F.sum("c").alias("c"))


def _ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each key, equal for equal keys."""
    order = np.argsort(key)
    key = key[order]
    step = np.zeros(len(key), np.uint32)
    step[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def equal_strings(pieces: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over the strings of `span` bytes inside the pieces: (piece, start, class) in its order.

    Ranks of 8 bytes are doubled up to more than half of `span`, and two overlapping ranks give the whole.
    """
    lens = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(pieces) + bytes(span), np.uint8)
    n = len(data) - 7
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= data[k : k + n]
    rank = _ranked(key)
    del key
    width = 8
    while width * 2 <= span:
        rank = _ranked((rank[:-width].astype(np.uint64) << np.uint64(32)) | rank[width:])
        width *= 2
    windows = np.maximum(0, lens - span + 1)
    p = _ranges(begins, windows)
    owner = np.repeat(np.arange(len(pieces)), windows)
    whole = (rank[p].astype(np.uint64) << np.uint64(32)) | rank[p + span - width]
    order = np.argsort(whole, kind="stable")
    cls = np.cumsum(np.concatenate([[0], whole[order][1:] != whole[order][:-1]])) if len(order) else order
    return owner[order], (p - begins[owner])[order], cls


PIECE = f"m long, h long, c long, {KEY} binary, start long, r int, n int, size int, piece binary"
_PIECE = [x.split()[0] for x in PIECE.split(", ")]
_KINDS = dict(zip(_PIECE, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True))


def _pieces(cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[n], _KINDS[n]) for n in _PIECE], _PIECE)


def _compared(rows: DataFrame, span: int) -> DataFrame:
    """From pieces sorted by (m, h), whole grams in a task: (key, start, length) of what a piece shares with another."""

    def spans(held: list[tuple]) -> pa.RecordBatch | None:
        keys, starts, counts, pieces = zip(*held, strict=True)
        owner, at, cls = equal_strings(list(pieces), span)
        again = np.bincount(cls, minlength=1)[cls] > 1
        again &= np.array(counts)[owner] == 1  # pieces that repeat as a whole are known already
        owner, at = owner[again], at[again]
        if not len(owner):
            return None
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + span)]))
        last = np.append(first[1:], len(at)) - 1
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(owner[first])), pa.array(np.array(starts)[owner[first]] + at[first]), pa.array(at[last] - at[first] + span)], [KEY, "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, gram, seen = 0, None, None
        for b in batches:
            for m, h, c, key, start, piece in zip(*(b.column(n).to_pylist() for n in ("m", "h", "c", KEY, "start", "piece")), strict=True):
                if m != gram:
                    if size > PIECES:
                        if (out := spans(held)) is not None:
                            yield out
                        held, size = [], 0
                    gram, seen = m, None
                if h == seen:
                    continue  # of a row alike
                seen = h
                held.append((key, start, c, piece))
                size += len(piece)
        if held and (out := spans(held)) is not None:
            yield out

    return rows.select("m", "h", "c", KEY, "start", "piece").mapInArrow(run, f"{KEY} binary, start long, length long")


def _halved(rows: DataFrame, width: int, span: int) -> DataFrame:
    """Pieces split by the distance of their strings to the anchor into intervals of `width`, under the hash of what all strings of the interval would share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column("piece").to_pylist()
            for s in by_bytes(b.column("size").to_pylist(), SLICE):
                part = pieces[s]
                lens = np.array([len(x) for x in part], np.int64)
                begins = np.cumsum(lens) - lens
                prefix = Prefixes(np.frombuffer(b"".join(part), np.uint8))
                m, r, n = (b.column(c).to_numpy()[s].astype(np.int64) for c in ("m", "r", "n"))
                c, key, start = (b.column(x).to_pylist()[s] for x in ("c", KEY, "start"))
                cols: dict[str, list] = {x: [] for x in _PIECE}
                for low in range(int((r - n + 1).min()) // width * width, int(r.max()) + 1, width):
                    top, least = np.minimum(r, low + width - 1), np.maximum(r - n + 1, low)
                    some = np.flatnonzero(top >= least)
                    skip, many = (r - top)[some], (top - least + 1)[some]
                    core = begins[some] + r[some] - (low + width - 1)  # where the interval's last string would begin
                    shared = prefix.of(core + width - 1, core + span)
                    left = begins[some] + skip
                    whole = mix(prefix.of(left, left + many + span - 1) + mix(top[some].astype(np.uint64)))
                    cols["m"] += mix(shared ^ mix(m[some].astype(np.uint64) + np.uint64(low * 1024 + width))).view(np.int64).tolist()
                    cols["h"] += whole.view(np.int64).tolist()
                    cols["r"] += top[some].tolist()
                    cols["n"] += many.tolist()
                    cols["size"] += (many + span - 1).tolist()
                    for k, x, y in zip(some.tolist(), skip.tolist(), many.tolist(), strict=True):
                        cols["c"].append(c[k]), cols[KEY].append(key[k]), cols["start"].append(start[k] + x)
                        cols["piece"].append(part[k][x : x + y + span - 1])
                yield _pieces(cols)

    return rows.select(*_PIECE).mapInArrow(run, PIECE)


def _shared(scratch: Scratch, pieces: DataFrame, span: int, gram: int) -> list[DataFrame]:
    """Tables of (key, start, length): what the pieces of each gram, distinct and two or more, share with each other."""
    found, width = [], 1 << (span - gram).bit_length()
    while True:
        sizes = pieces.groupBy("m").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("d")).where("d > 1").withColumn("crowded", F.col("bytes") > CROWD)
        sizes = scratch.keep(sizes.select("m", "crowded"), "sizes")
        few = pieces.join(sizes.where("not crowded"), "m", "left_semi")
        found.append(_compared(few.repartition("m").sortWithinPartitions("m", "h"), span))
        if sizes.where("crowded").isEmpty():
            return found
        width //= 2
        halves = scratch.keep(_halved(pieces.join(sizes.where("crowded"), "m", "left_semi"), width, span), "halves")
        one = F.struct(*[c for c in _PIECE if c not in ("m", "h", "c")])
        pieces = scratch.keep(halves.groupBy("m", "h").agg(F.sum("c").alias("c"), F.min(one).alias("one")).select("m", "h", "c", "one.*"), "pieces")
        again = halves.where("c = 1").join(pieces.where("c > 1").select("m", "h"), ["m", "h"], "left_semi")
        found.append(again.select(KEY, "start", (F.col("n") + span - 1).cast("long").alias("length")))


def _cut(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of wanted stretches: wanted has (key, pieces: array of (m, h, c, start, r, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {n: [] for n in _PIECE}
            size = 0
            for k in range(b.num_rows):
                raw = (b.column("_sk_text")[k].as_py() or "").encode("utf-8", "surrogatepass")
                for x in b.column("pieces")[k].as_py():
                    for n in ("m", "h", "c", "start", "r", "n"):
                        cols[n].append(x[n])
                    piece = raw[x["start"] : x["start"] + x["n"] + span - 1]
                    cols[KEY].append(b.column(KEY)[k].as_py()), cols["size"].append(len(piece)), cols["piece"].append(piece)
                    size += len(piece)
                    if size > SLICE:
                        yield _pieces(cols)
                        cols, size = {n: [] for n in _PIECE}, 0
            yield _pieces(cols)

    return docs.join(wanted, KEY).select(KEY, "_sk_text", "pieces").mapInArrow(run, PIECE)


def repeated_spans(spark: SparkSession, keyed: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(key, spans: array of (start, length)) for rows of (key, _sk_text) that hold a repeated string. Spans may overlap."""
    family, repeated, every = IndexFamily(scratch), None, None
    for k in range(batches):
        batch = scratch.keep(entries(keyed.where(F.pmod(F.xxhash64(KEY), F.lit(batches)) == k), span, gram), "entries")
        new = family.add(batch)
        repeated = new if repeated is None else repeated.union(new)
        every = batch if every is None else every.union(batch)
    repeated = scratch.keep(repeated.distinct(), "repeated")
    alike = scratch.keep(family.array().join(repeated, "m", "left_semi"), "alike")
    for _, level in family.levels:
        scratch.drop(level)
    differ = scratch.keep(alike.groupBy("m").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "differ")
    alike = scratch.keep(alike.join(differ, "m", "left").select("m", "h", "c", F.col("d").isNotNull().alias("differs")).where("c > 1 or differs"), "alike")
    mine = scratch.keep(every.join(alike, ["m", "h"]), "mine")
    scratch.release()
    whole = mine.where("c > 1").select(KEY, "start", (F.col("n") + span - 1).cast("long").alias("length"))
    place = F.struct(KEY, "start", "r", "n")
    often = mine.where("differs and c > 1").groupBy("m", "h").agg(F.min("c").alias("c"), F.min(place).alias("one")).select("m", "h", "c", "one.*")
    asked = mine.where("differs and c = 1").select("m", "h", "c", KEY, "start", "r", "n").union(often)
    wanted = asked.groupBy(KEY).agg(F.collect_list(F.struct("m", "h", "c", "start", "r", "n")).alias("pieces"))
    pieces = scratch.keep(_cut(keyed, wanted, span), "pieces")
    scratch.release()
    rows = whole
    for x in _shared(scratch, pieces, span, gram):
        rows = rows.union(x)
    # rows alike share their key and find the same spans
    out = scratch.keep(rows.groupBy(KEY).agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")
    scratch.release()
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the union of spans (start, length)."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out]


RESULTS = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
)


def strip(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (bytes of cut characters left out)."""
    scratch = Scratch(spark, "suffixes")
    docs = docs.drop(*RESULTS.names)
    keyed = docs.withColumn(KEY, row_key(id_col, text_col)).withColumn("_sk_text", F.col(text_col))
    spans = repeated_spans(spark, keyed.select(KEY, "_sk_text"), scratch, span, gram, batches)
    results = T.StructType(RESULTS.fields if with_text else RESULTS.fields[:-1])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            sizes = pc.fill_null(pc.binary_length(whole.column("_sk_text")), 0).to_pylist()
            for b in (whole.slice(s.start, s.stop - s.start) for s in by_bytes(sizes, 4 * SLICE)):
                rows = []
                for text, cut in zip(b.column("_sk_text").to_pylist(), b.column("_sk_spans").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    runs = merged([(x["start"], x["length"]) for x in cut or ()])
                    kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True)) if runs else raw
                    rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), (kept.decode("utf-8", "ignore") if runs else text) if with_text else None))
                names = [n for n in b.schema.names if n not in ("_sk_text", "_sk_spans")]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(results)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, *results.names])

    kept = [f for f in docs.schema.fields if with_text or f.name != text_col]
    rows = keyed.join(spans.withColumnRenamed("spans", "_sk_spans"), KEY, "left").select(*[f"`{f.name}`" for f in kept], "_sk_text", "_sk_spans")
    return rows.mapInArrow(run, T.StructType([*kept, *results.fields]))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated passages; n_chars follows the text. A document of which nothing is left goes."""
    del sf_dir
    out = strip(spark, docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where((F.col("n_removed") == 0) | (F.length("text") > 0)).select(*docs.columns)
