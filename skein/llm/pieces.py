"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and indexed by a suffix array (sorted by as many characters as
the longest piece has, packed into machine words). Every piece of the vocabulary is binary-searched in it
for the range of its occurrences; the occurrences are edges of one lattice per word. The edges are sorted by where they end
and relaxed in that order, all words at once: a merge-order (BPE) encoding is the one path from a
word's start on which each two neighbouring pieces stay apart when only they are encoded, so an edge is
taken if its piece can follow the piece that its start was reached by.

Words never share a piece: in the vocabularies taken here the space mark stands only at the front of a
piece, so a text splits before each run of space marks. A worker keeps the encodings of words that it
has seen, and forgets the less used ones beyond CACHE words; that changes nothing in the result.

Defined results: null and empty texts have no pieces; characters without a piece become byte pieces;
rows alike are encoded alike; an empty table gives no rows; further columns pass through, but for those
named like the results, which give way to them. A text that holds the space mark itself decodes to spaces
there, and round_trip is false for it. Where a vocabulary's merges leave a word without such a path, the
word is encoded by merging its characters one pair at a time.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import by_bytes, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of whose encodings a worker keeps hold, characters of text and of new words that it works on at once.
CACHE = 200_000
CHUNK, INDEXED = 2_000_000, 250_000
#: Places, a power of two in bits, in which a worker remembers what may follow what.
FOLLOWS = 18
_MARK = "▁"
_WORDS = re.compile(f"{_MARK}+[^{_MARK}]*")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Vocabulary:
    """A BPE model file: pieces, their order of merging, and which piece may follow which."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.output = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([i - self.bytes_at]) if sp.is_byte(i) else sp.id_to_piece(i).replace(_MARK, " ").encode() for i in range(n)]
        self.ids = np.array([i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))], np.int64)
        self.pieces = [sp.id_to_piece(int(i)) for i in self.ids]
        if any(_MARK in p.lstrip(_MARK) for p in self.pieces) or "".join(sp.normalize("A éﬁ")) != f"{_MARK}A{_MARK}éﬁ":
            raise ValueError("pieces must have the space mark at the front only, and texts must not be normalised")
        self.order = {p: sp.get_score(int(i)) for p, i in zip(self.pieces, self.ids, strict=True)}
        self.number = {p: k for k, p in enumerate(self.pieces)}
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.lengths.max())
        self.spelled = np.zeros((len(self.pieces), self.longest), np.int64)
        for k, p in enumerate(self.pieces):
            self.spelled[k, : len(p)] = _code_points(p) + 1
        self.unknown = len(self.pieces)
        self.met, self.yes = np.full(1 << FOLLOWS, -1, np.int64), np.zeros(1 << FOLLOWS, bool)
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges of the best adjacent pair, leftmost first, until none is in the vocabulary."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.order.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.order:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether piece can come after the piece before it (-1: the word's start)."""
        codes = (before + 1) * (self.unknown + 1) + piece
        place = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FOLLOWS)).astype(np.int64)
        out = self.yes[place]
        new = np.flatnonzero(self.met[place] != codes)
        if len(new):
            ask, where = np.unique(codes[new], return_inverse=True)
            yes = np.fromiter(map(self._follows, ask.tolist()), bool, len(ask))
            out[new] = yes[where]
            at = place[new]
            self.met[at] = codes[new]
            # of several that share a place the last one written stays, with its own answer
            self.yes[at] = yes[np.searchsorted(ask, self.met[at])]
        return out

    def _follows(self, code: int) -> bool:
        if (yes := self.follows.get(code)) is None:
            a, b = divmod(code, self.unknown + 1)
            a -= 1
            if b == self.unknown or a == self.unknown:
                yes = True
            else:
                two = [*([self.pieces[a]] if a >= 0 else []), self.pieces[b]]
                yes = self.merged("".join(two)) == two
            if len(self.follows) >= 1 << FOLLOWS:
                self.follows.clear()
            self.follows[code] = yes
        return yes


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Once per worker. The file has to be at the same place on every machine."""
    return Vocabulary(path)


class Suffixes:
    """The suffixes of codes (0 ends a word) in the order of their first `depth` codes."""

    def __init__(self, codes: np.ndarray, depth: int) -> None:
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        self.number = np.full(len(seen), -1, np.int64)
        self.number[seen] = np.arange(int(seen.sum()))
        self.bits = max(1, int(seen.sum() - 1).bit_length())
        self.per = 63 // self.bits
        levels = -(-depth // self.per)
        dense = np.concatenate([self.number[codes], np.zeros(levels * self.per, np.int64)])
        keys = [self._packed(lambda t, k=k: dense[k * self.per + t : k * self.per + t + len(codes)]) for k in range(levels)]
        self.order = np.argsort(keys[0])
        group = np.zeros(len(codes), np.int64)
        for k, key in enumerate(keys[1:]):  # only suffixes that are alike so far are sorted by more
            before = keys[k][self.order]
            group[1:] += np.cumsum(before[1:] != before[:-1])
            tied = np.flatnonzero(np.bincount(group)[group] > 1)
            alike = self.order[tied]
            self.order[tied] = alike[np.lexsort((key[alike], group[tied]))]
        self.keys = [x[self.order] for x in keys]

    def _packed(self, at) -> np.ndarray:  # noqa: ANN001
        out = at(0).copy()
        for t in range(1, self.per):
            out = (out << self.bits) | at(t)
        return out

    def find(self, spelled: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the range of `order` whose suffixes begin with it, by binary search for all pieces at once."""
        inside = spelled < len(self.number)
        dense = np.where(inside, self.number[np.where(inside, spelled, 0)], -1)
        there = np.flatnonzero(((dense >= 0) | (np.arange(spelled.shape[1]) >= lengths[:, None])).all(1))
        width = len(self.keys) * self.per
        low = np.zeros((len(there), width), np.int64)
        low[:, : spelled.shape[1]] = np.where(spelled[there] > 0, dense[there], 0)[:, :width]
        high = np.where(np.arange(width) < lengths[there, None], low, (1 << self.bits) - 1)
        pack = lambda x, k: self._packed(lambda t: x[:, k * self.per + t])
        begin, end = np.zeros(len(there), np.int64), np.full(len(there), len(self.order), np.int64)
        for k, key in enumerate(self.keys):
            live = np.flatnonzero((lengths[there] > k * self.per) & (begin < end))
            a, b = pack(low[live], k), pack(high[live], k)
            if k == 0:
                begin[live], end[live] = np.searchsorted(key, a, "left"), np.searchsorted(key, b, "right")
            else:
                begin[live], end[live] = _between(key, a, begin[live], end[live], False), _between(key, b, begin[live], end[live], True)
        lo, hi = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64)
        lo[there], hi[there] = begin, end
        return lo, hi


def _between(key: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each wanted value in its own range of key."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = key[mid] <= want[live] if right else key[mid] < want[live]
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def _sorted(values: np.ndarray) -> np.ndarray:
    """A stable argsort; numbers below 2**16 are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i]+counts[i]-1, one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of words that each begin with the space mark and are not empty."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    text = _code_points("".join(words)) + 1
    starts = np.cumsum(lens) - lens + np.arange(len(words))
    word_of = np.repeat(np.arange(len(words)), lens)
    codes = np.zeros(len(text) + len(words), np.int64)  # a 0 after each word
    codes[np.arange(len(text)) + word_of] = text
    index = Suffixes(codes, v.longest)
    lo, hi = index.find(v.spelled, v.lengths)
    start = index.order[_ranges(lo, hi - lo)]
    piece = np.repeat(np.arange(len(v.pieces)), hi - lo)
    long = v.lengths[piece]
    alone = codes > 0
    alone[start[long == 1]] = False
    bare = np.flatnonzero(alone)
    start, piece, long = np.concatenate([start, bare]), np.concatenate([piece, np.full(len(bare), v.unknown)]), np.concatenate([long, np.ones(len(bare), np.int64)])
    inside = np.zeros(len(codes), np.int64)
    inside[np.arange(len(text)) + word_of] = np.arange(len(text)) - np.repeat(np.cumsum(lens) - lens, lens)
    ends = inside[start] + long
    by_end = _sorted(ends)
    start, piece, long, ends = start[by_end], piece[by_end], long[by_end], ends[by_end]
    reached = np.full(len(codes) + 1, -2, np.int64)  # by which piece; -1: a word's start, -2: not at all
    came = np.zeros(len(codes) + 1, np.int64)
    reached[starts] = -1
    cuts = np.append(np.flatnonzero(np.diff(ends, prepend=0)), len(ends))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s, p = start[a:b], piece[a:b]
        before = reached[s]
        ok = np.flatnonzero(before != -2)
        ok = ok[v.may_follow(before[ok], p[ok])]
        to = s[ok] + long[a:b][ok]
        reached[to], came[to] = p[ok], s[ok]
    at, which = starts + lens, np.arange(len(words))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(reached[at] == -2).tolist():
        parts = v.merged(words[k])[::-1]
        found += [(np.array([k]), np.array([v.number.get(x, v.unknown)]), np.array([ord(x[0])])) for x in parts]
    on = reached[at] != -2
    at, which = at[on], which[on]
    while len(which):
        found.append((which, reached[at], codes[came[at]] - 1))
        at = came[at]
        on = at > starts[which]
        at, which = at[on], which[on]
    which, piece, char = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
    by_word = _sorted(which)
    which, piece, char = which[by_word], piece[by_word], char[by_word]
    unknown = piece == v.unknown
    n_bytes = np.where(unknown, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
    ids = np.repeat(v.ids[np.where(unknown, 0, piece)], n_bytes)
    if unknown.any():
        utf8 = b"".join(chr(c).encode("utf-8", "surrogatepass") for c in char[unknown].tolist())
        ids[np.repeat(unknown, n_bytes)] = np.frombuffer(utf8, np.uint8).astype(np.int64) + v.bytes_at
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(which, n_bytes, len(words)).astype(np.int64), out=offsets[1:])
    return offsets, ids.astype(np.int32)


class Encoder:
    """Encodes batches of texts, with the encodings of words seen before at hand."""

    def __init__(self, v: Vocabulary, cache: int = CACHE) -> None:
        self.v, self.cache = v, cache
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.offsets, self.ids, self.uses = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the words used most often, half as many as it may hold at most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.cache // 2])
        kept = kept[self.uses[kept] > 1]
        n = self.offsets[kept + 1] - self.offsets[kept]
        self.ids = self.ids[_ranges(self.offsets[kept], n)]
        self.offsets = np.concatenate([[0], np.cumsum(n)])
        self.uses = self.uses[kept] // 2
        words = list(self.index)
        self.index = {words[k]: i for i, k in enumerate(kept.tolist())}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        if len(self.index) > self.cache:
            self.forget()
        index, counts, words = self.index, [], []
        size = len(index)
        for t in texts:
            if not t:
                counts.append(0)
                continue
            own = t.split(" ")
            if "" in own or _MARK in t:
                own = [w[1:] for w in _WORDS.findall(_MARK + t.replace(" ", _MARK))]
            counts.append(len(own))
            words += own
        where = np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(where < 0).tolist():
            where[k] = index.setdefault(words[k], len(index))
        if len(index) > size:
            new = [_MARK + w for w in itertools.islice(index, size, None)]
            for part in by_bytes([len(w) for w in new], INDEXED):
                more, ids = encode_words(self.v, new[part])
                self.offsets = np.concatenate([self.offsets, self.offsets[-1] + more[1:]])
                self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(index) - size, np.int64)]) + np.bincount(where, minlength=len(index))
        n = self.offsets[where + 1] - self.offsets[where]
        flat = self.ids[_ranges(self.offsets[where], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ends[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])], flat


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    raw = b"".join(map(v.output.__getitem__, ids)).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, out: str = "piece_ids") -> DataFrame:
    """docs with an array of piece ids and round_trip, whether they decode to the text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, enc = vocabulary(model), _encoder(model)
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column("_sk_text")), 0).to_pylist()
            for part in (b.slice(s.start, s.stop - s.start) for s in by_bytes(sizes, CHUNK)):
                texts = [t or "" for t in part.column("_sk_text").to_pylist()]
                offsets, ids = enc.encode(texts)
                flat = ids.tolist()
                same = [decode_ids(v, flat[x:y]) == t for t, x, y in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                arrays = [part.column(k) for k, n in enumerate(part.schema.names) if n != "_sk_text"]
                names = [n for n in part.schema.names if n != "_sk_text"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())], [*names, "_sk_ids", "_sk_same"])

    kept = docs.drop(out, "round_trip")
    schema = T.StructType([*kept.schema.fields, T.StructField("_sk_ids", T.ArrayType(T.IntegerType())), T.StructField("_sk_same", T.BooleanType())])
    found = kept.withColumn("_sk_text", F.col(text_col)).mapInArrow(run, schema)
    return found.withColumnsRenamed({"_sk_ids": out, "_sk_same": "round_trip"})


def decode(encoded: DataFrame, ids_col: str = "piece_ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """encoded with the text of its piece ids; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        v = vocabulary(model)
        return ids.map(lambda x: None if x is None else decode_ids(v, list(x)))

    return encoded.withColumn(out, text(F.col(ids_col)))


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids to train on, in place of the text.

    Rows come in training order: by the number of the file that they were written to, and in it by row. Readers
    deal files out by size, so that place is kept as file and file_row (0 and null where docs are no files).
    """
    del spark, sf_dir
    try:
        placed = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("_sk_part"), F.col("_metadata.row_index").alias("_sk_at"))
    except AnalysisException:
        placed = docs.withColumns({"_sk_part": F.lit(""), "_sk_at": F.lit(None).cast("long")})
    out = encode(placed).drop("text", "file", "file_row")
    part = F.coalesce(F.col("_sk_part").try_cast("long"), F.lit(0))
    return out.withColumns({"file": part, "file_row": F.col("_sk_at"), "n_pieces": F.size("piece_ids").cast("long")}).drop("_sk_part", "_sk_at")
