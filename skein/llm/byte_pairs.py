"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

Java's regular expressions cut texts into words, with the same classes as the library's. The distinct words of a
task's documents are encoded in the JVM, block by block. All stretches of a word's bytes are looked up in a literal map of the
ranks, which is dealt into buckets by a checksum, since Spark searches a map from its first key on. The stretches
that are tokens, sorted by rank and place, are the merges that may come; a fold over them keeps the bounds of the
parts as bits of a number, and takes the bound between the two parts of a merge away if both are whole just then.
That is the order of the library: a token is made from one pair only, the last of its own bytes' merging, and in the
vocabularies taken here a merge never makes a pair of lower rank than its own; both are checked when a file is read.
Words too long for the bits of a number are strings of one character for each token, at first one for each byte, and
their fold replaces the pair of least rank by its token at all places at once, from the left, again and again.

Python only gathers the words of a block that its task has not met yet, and deals all words' tokens out; nothing is
shuffled. Decoding lays the
bytes of the pieces of a list of ids side by side.

Defined results: null and empty texts have no tokens; texts that look like special tokens are ordinary text; rows
alike are encoded alike; an empty table gives no rows; further columns pass through, but for one named like the
result, which gives way to it. A word of a million letters is folded like any other, in a few hundred passes.
A text's words are one array, so a text has to fit into a task's memory about ten times over.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import importlib
import json
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from skein.llm.common import by_bytes, table

#: Folder of the vocabulary files and of the module that has their pattern. Only the driver reads them.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Bytes of text of a block, words that are dealt out at once, words that a task knows, and input partitions of a task.
BLOCK, DEALT, KNOWN, SPLITS = 4_000_000, 100_000, 2_000_000, 8
#: Bytes of the query's batches to Python.
BATCH = 8_000_000
#: Buckets of the rank map, and bytes of a word whose bounds are the bits of a number.
BUCKETS, SHORT = 1 << 17, 56
#: Token i is the character FIRST + i, which takes WIDTH bytes.
FIRST, WIDTH = 0x10000, 4

# White space, and letters and digits that Unicode has added since its version 13, which older JVMs know.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NEW = {
    "L": (
        "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 "
        "A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC "
        "105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 "
        "1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 "
        "11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB "
        "1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
        "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
    ),
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA",
}


def java_pattern(pattern: str) -> str:
    """The pattern of a vocabulary in Java's syntax. Of classes it may have letters, numbers and white space."""
    added = {k: "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in v.split()) for k, v in _NEW.items()}
    inside = {rf"\p{{{k}}}": rf"\p{{{k}}}[\x{{870}}-\x{{10FFFF}}&&[{v}]]" for k, v in added.items()} | {r"\s": _SPACE}

    def java(m: re.Match) -> str:
        told = m[0]
        if told.startswith("["):
            not_, body = ("^", told[2:-1]) if told.startswith("[^") else ("", told[1:-1])
            return f"[{not_}{re.sub(r'\\p\{[LN]\}|\\s', lambda x: inside[x[0]], body)}]"
        return f"[^{_SPACE}]" if told == r"\S" else f"[{inside[told]}]"

    out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", java, pattern)
    if re.search(r"\\[^tr xp]", out) or r"\p" in re.sub(r"\\p\{[LN]\}", "", out):
        raise ValueError(f"the pattern has classes that are not known here: {pattern}")
    return out


def default_pattern(folder: str = TOKENIZERS) -> str:
    if "public_tokenizers" not in sys.modules:
        sys.path.append(folder.rsplit("/", 1)[0])
    return importlib.import_module("public_tokenizers").PATTERN


def char(token: int) -> str:
    return chr(FIRST + token)


class Ranks:
    """A rank file: the tokens' bytes and the pair that each token of two bytes or more is merged from."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.rank for b in range(256)) or max(self.rank.values()) >= 0x110000 - FIRST:
            raise ValueError("every byte has to be a token, and ids have to be below 2**20")
        self.pieces = [b""] * (max(self.rank.values()) + 1)
        for piece, r in self.rank.items():
            self.pieces[r] = piece
        self.pairs = {r: pair for piece, r in self.rank.items() if (pair := self._last_merge(piece))}

    def _last_merge(self, piece: bytes) -> tuple[int, int] | None:
        parts, before, none = [piece[i : i + 1] for i in range(len(piece))], -1, len(self.pieces)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none or least < before:
                raise ValueError(f"merges do not lead to the token {piece!r} in the order of their ranks")
            k, before = ranks.index(least), least
            if len(parts) == 2:
                return self.rank[parts[0]], self.rank[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


class Literals:
    """A vocabulary as literals of an expression. Spark parses each once, when it folds constants."""

    def __init__(self, v: Ranks) -> None:
        every = range(len(v.pieces))
        spelled = {r: char(a) + char(b) for r, (a, b) in v.pairs.items()}
        # a stretch by its bytes in hexadecimal: rank, and room for its start
        self.stretches = self._map({p.hex().upper(): r << 6 for p, r in v.rank.items() if len(p) <= SHORT}, "bigint")
        # by rank: the bits of a token's stretch, those of its bounds while its two parts are whole, and the one between them
        cut = [len(v.pieces[v.pairs[r][0]]) if r in v.pairs else 0 for r in every]
        small = [len(p) if len(p) <= SHORT else 0 for p in v.pieces]
        told = lambda numbers: F.from_json(F.lit(json.dumps(list(numbers))), "array<bigint>")
        self.spans, self.cuts = told((2 << n) - 1 for n in small), told(1 << k for k in cut)
        self.parts = told(1 | 1 << k | 1 << n for k, n in zip(cut, small, strict=True))
        self.ranks = self._map({pair: r for r, pair in spelled.items()}, "int")
        self.pairs = F.split(F.lit(",".join(spelled.get(r, "") for r in every)), ",")
        self.tokens = F.split(F.lit(",".join(map(char, every))), ",")
        self.bytes = "".join(char(v.rank[bytes([b])]) for b in range(256))
        longest = max(map(len, v.pieces))
        # a place: how many hexadecimal digits it has, and where its bytes start
        places = [[2 * k << 6 | i for i in range(n) for k in range(2, min(longest, n - i) + 1)] for n in range(SHORT + 1)]
        self.places = F.from_json(F.lit(json.dumps(places)), "array<array<int>>")

    @staticmethod
    def _map(told: dict[str, int], kind: str) -> Column:
        buckets: list[dict[str, int] | None] = [None] * BUCKETS
        for key, value in told.items():
            at = zlib.crc32(key.encode()) % BUCKETS
            buckets[at] = (buckets[at] or {}) | {key: value}
        return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")

    @staticmethod
    def _in(buckets: Column, key: Column) -> Column:
        """What the map has for a key (binary), null if nothing."""
        return F.element_at(buckets[F.crc32(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")], key.cast("string"))

    def short(self, raw: Column) -> Column:
        """The ids of a word of SHORT bytes at most."""
        return _let(F.hex(raw).cast("binary"), lambda digits: self._short(F.octet_length(raw), digits))

    def _short(self, n: Column, digits: Column) -> Column:
        right = lambda x, by: F.call_function("shiftright", x, by)
        left = lambda x, by: F.call_function("shiftleft", x, by)

        def merge(bounds: Column, m: Column) -> Column:
            start, rank = m.bitwiseAND(F.lit(63)).cast("int"), right(m, F.lit(6)).cast("int")
            whole = right(bounds, start).bitwiseAND(self.spans[rank]) == self.parts[rank]
            return F.when(whole, bounds - left(self.cuts[rank], start)).otherwise(bounds)

        def place(x: Column) -> Column:
            start = x.bitwiseAND(F.lit(63))
            return self._in(self.stretches, F.substring(digits, start * 2 + 1, right(x, F.lit(6)))) + start

        def rank(x: Column, k: Column, i: Column) -> Column:
            return right(self._in(self.stretches, F.substring(digits, k * 2 + 1, (x[i + 1] - k) * 2)), F.lit(6)).cast("int")

        merges = F.sort_array(F.filter(F.transform(self.places[n], place), lambda m: m.isNotNull()))
        bounds = F.aggregate(merges, left(F.lit(1).cast("long"), n + 1) - 1, merge)
        at = _let(bounds, lambda b: F.filter(F.sequence(F.lit(0), n), lambda k: right(b, k).bitwiseAND(F.lit(1)) == 1))
        return _let(at, lambda x: F.transform(F.slice(x, 1, F.size(x) - 1), lambda k, i: rank(x, k, i)))

    def _least(self, s: Column) -> Column:
        """The least rank of two neighbouring tokens of s, null if no two of them merge."""

        def ranked(raw: Column) -> Column:
            def rank(k: Column) -> Column:
                return self._in(self.ranks, F.substring(raw, k * WIDTH + 1, F.lit(2 * WIDTH)))

            return F.array_min(F.transform(F.sequence(F.lit(0), many - 2), rank))

        many = (F.octet_length(s) / WIDTH).cast("int")
        return F.when(many > 1, _let(s.cast("binary"), ranked))

    def long(self, raw: Column) -> Column:
        """The ids of a word of any length."""
        start = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(256))), self.bytes)

        def state(s: Column) -> Column:
            return F.struct(s.alias("s"), self._least(s).alias("least"))

        def merge(now: Column, _: Column) -> Column:
            pair, token = self.pairs[now["least"]], self.tokens[now["least"]]
            return F.when(now["least"].isNull(), now).otherwise(_let(F.replace(now["s"], pair, token), state))

        def ids(s: Column) -> Column:
            each = F.sequence(F.lit(0), (F.octet_length(s) / WIDTH).cast("int") - 1)
            return _let(s.cast("binary"), lambda b: F.transform(each, lambda k: F.ascii(F.substring(b, k * WIDTH + 1, F.lit(WIDTH)).cast("string")) - FIRST))

        passes = F.sequence(F.lit(1), F.octet_length(raw))
        return F.aggregate(passes, _let(start, state), merge, lambda now: _let(now["s"], ids))

    def word(self, word: Column) -> Column:
        return _let(word.cast("binary"), lambda raw: F.when(F.octet_length(raw) <= SHORT, self.short(raw)).otherwise(self.long(raw)))

    def encode(self, words: Column) -> Column:
        """The ids of each of an array of words, none empty. A lambda binds each literal, so that it stands in the plan once."""

        def bound(names: list[str]) -> Column:
            if not names:
                return F.transform(words, self.word)

            def then(x: Column) -> Column:
                setattr(self, names[0], x)
                return bound(names[1:])

            return _let(getattr(self, names[0]), then)

        return bound(["stretches", "spans", "parts", "cuts", "places", "ranks", "pairs", "tokens"])


class Result(NamedTuple):
    """A column made of the ids of a run of texts."""

    name: str
    kind: pa.DataType
    make: Callable[[pa.ListArray], pa.Array | list]


def _block(b: pa.RecordBatch, words: pa.ListArray, known: pa.Array) -> tuple[pa.RecordBatch, pa.Array]:
    """One row for many, with every column as a list, and all words known by now. Words new to the task go along."""
    found = words.flatten().dictionary_encode()
    known = known if len(known) < KNOWN else known.slice(0, 0)
    place = pc.index_in(found.dictionary, known)
    new = found.dictionary.filter(place.is_null())
    new = new.take(pc.sort_indices(new))  # neighbours look up much the same
    place = pc.coalesce(place, pc.add(pc.index_in(found.dictionary, new), pa.scalar(len(known), pa.int32())))
    listed = [*b.columns, pc.list_value_length(words), place.take(found.indices), new]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in listed]
    row = pa.RecordBatch.from_arrays([*lists, pa.array([len(known)], pa.int32())], [*b.schema.names, "_sk_counts", "_sk_codes", "_sk_new", "_sk_known"])
    return row, pa.concat_arrays([known, new])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def _dealt(blocks: Iterator[pa.RecordBatch], names: list[str], results: list[Result]) -> Iterator[pa.RecordBatch]:
    """The rows of a task's blocks, with what the results make of the ids of their tokens."""
    sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of the words that the task knows
    for b, k in ((b, k) for b in blocks for k in range(b.num_rows)):
        row = {n: b.column(i)[k] for i, n in enumerate(b.schema.names)}
        col = {n: x.values for n, x in row.items() if n != "_sk_known"}
        codes, counts = col["_sk_codes"].to_numpy(), col["_sk_counts"].to_numpy().astype(np.int64)
        if row["_sk_known"].as_py() == 0:
            sizes, ids = sizes[:0], ids[:0]
        sizes = np.concatenate([sizes, pc.list_value_length(col["_sk_coded"]).to_numpy()])
        ids = np.concatenate([ids, col["_sk_coded"].flatten().to_numpy()])
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(counts)
        for s in by_bytes(counts.tolist(), DEALT):
            own = codes[ends[s.start] - counts[s.start] : ends[s.stop - 1]]
            upto = np.concatenate([[0], np.cumsum(sizes[own])])
            offsets = upto[ends[s.start : s.stop] - ends[s.start] + counts[s.start]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]).astype(np.int32)), pa.array(ids[_ranges(starts[own], sizes[own])], pa.int32()))
            made = [x if isinstance(x := r.make(lists), pa.Array) else pa.array(x, r.kind) for r in results]
            yield pa.RecordBatch.from_arrays([*(col[x].slice(s.start, s.stop - s.start) for x in names), *made], [*names, *(r.name for r in results)])
        pa.default_memory_pool().release_unused()


def _large_tasks(rows: DataFrame) -> DataFrame:
    """SPLITS partitions to a task, as long as there is a task for each core: the larger a task, the fewer words are new in it."""
    now = rows.rdd.getNumPartitions()
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-now // SPLITS))
    return rows.coalesce(wanted) if wanted < now else rows


def _tokens(docs: DataFrame, kept: DataFrame, text_col: str, vocabulary: str, pattern: str | None, results: list[Result]) -> DataFrame:
    """The columns of docs that kept has, and the results of the ids."""
    literals = Literals(ranks(vocabulary))
    names = [f"_sk_{k}" for k in range(len(kept.columns))]
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(java_pattern(pattern or default_pattern())), F.lit(0))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names, strict=True)], F.coalesce(found, F.array().cast("array<string>")).alias("_sk_words"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([], pa.string())
        for b in batches:
            words = b.column("_sk_words")
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(words.values).to_numpy(zero_copy_only=False), dtype=np.int64)])
            for s in by_bytes(np.diff(upto[words.offsets.to_numpy()]).tolist(), BLOCK):
                part = b.slice(s.start, s.stop - s.start)
                row, known = _block(part.select(names), part.column("_sk_words"), known)
                yield row
                pa.default_memory_pool().release_unused()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(batches, names, results)

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)]
    inner = [T.StructField(n, T.IntegerType()) for n in ("_sk_counts", "_sk_codes")] + [T.StructField("_sk_new", T.StringType())]
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*fields, *inner]]
    blocks = _large_tasks(rows).mapInArrow(gather, T.StructType([*lists, T.StructField("_sk_known", T.IntegerType())]))
    coded = blocks.withColumn("_sk_coded", literals.encode(F.col("_sk_new"))).drop("_sk_new")
    dealt = coded.mapInArrow(deal, T.StructType([*fields, *(T.StructField(r.name, from_arrow_type(r.kind)) for r in results)]))
    return dealt.toDF(*kept.columns, *(r.name for r in results))


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str | None = None, out: str = "token_ids") -> DataFrame:
    """docs with an array of token ids, as the vocabulary's library gives them without special tokens. No shuffle."""
    return _tokens(docs, docs.drop(out), text_col, vocabulary, pattern, [Result(out, pa.list_(pa.int32()), lambda ids: ids)])


def joined(ids: pa.ListArray, pieces: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of the pieces of each list, one after another. Ids that the vocabulary lacks have none."""
    flat = ids.values.to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(pieces) - 1), flat, len(pieces) - 1)
    told = pieces.take(pa.array(flat))  # its bytes are side by side already
    at = np.frombuffer(told.buffers()[1], np.int32, len(told) + 1)[ids.offsets.to_numpy()]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [ids.buffers()[0] if not ids.offset else None, pa.py_buffer(at.tobytes()), told.buffers()[2]])


def _pieces(v: Ranks) -> pa.BinaryArray:
    return pa.array([*v.pieces, b""], pa.binary())


def decode(encoded: DataFrame, ids_col: str = "token_ids", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", out: str = "decoded") -> DataFrame:
    """encoded with the bytes (binary) of its token ids; null ids give null, a null among ids nothing."""
    pieces = _pieces(ranks(vocabulary))
    kept = encoded.drop(out)
    names = [f"_sk_{k}" for k in range(len(kept.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("_sk_ids")
            flat = pc.fill_null(ids.values, -1)
            lists = pa.ListArray.from_arrays(ids.offsets, flat)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pc.if_else(ids.is_valid(), joined(lists, pieces), None)], [*names, "_sk_out"])

    rows = encoded.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names, strict=True)], F.col(f"`{ids_col}`").cast("array<int>").alias("_sk_ids"))
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("_sk_out", T.BinaryType())])).toDF(*kept.columns, out)


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its number of tokens and the digests of the ids and of the bytes that they decode to."""
    vocabulary = f"{TOKENIZERS}/{VOCABULARY}"
    pieces = _pieces(ranks(vocabulary))

    def packed(ids: pa.ListArray) -> list[str]:
        raw, at = memoryview(ids.values.to_numpy().astype("<u4")).cast("B"), ids.offsets.to_numpy()
        return [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decoded(ids: pa.ListArray) -> list[str]:
        return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined(ids, pieces)]

    results = [Result("n_tokens", pa.int64(), lambda ids: pc.list_value_length(ids).cast(pa.int64())), Result("ids_sha256", pa.string(), packed), Result("decoded_sha256", pa.string(), decoded)]
    own = spark.newSession()  # with smaller batches to Python, which leaves the caller's settings alone
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    docs = table(own, sf_dir, "documents")
    return _tokens(docs, docs.select("doc_id"), "text", vocabulary, None, results)
