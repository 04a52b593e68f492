"""Hashes of bytes, words and word shingles of many texts at once, the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(64)
#: A random odd number for each byte.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64; kept between calls."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Prefixes:
    """Hashes of any stretches of a byte array, from running sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Shingles(NamedTuple):
    hashes: np.ndarray  # of all texts, one text's after another's
    counts: np.ndarray  # shingles of each text, repeats included
    words: np.ndarray  # words of each text
    order: np.ndarray  # a hash of each text's word sequence


def shingles(texts: list[bytes], size: int = 5) -> Shingles:
    """Hashes of all runs of `size` words; a text of fewer words, but some, has one shingle, of all of them."""
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.cumsum(lens + 1) - (lens + 1)
    space = IS_SPACE[data]
    inside = np.concatenate([[False], ~space])
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # data ends in a space: edges pair up
    start, end = edge[0::2], edge[1::2]
    word = Prefixes(data).of(start, end)
    words = np.diff(np.searchsorted(start, np.append(begins, len(data))))
    first = np.cumsum(words) - words
    up, down = powers(len(word) + 1)
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[:-1], out=sums[1:])
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    total = int(counts.sum())
    at = np.arange(total) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    width = np.repeat(np.minimum(words, size), counts)
    hashes = mix((sums[at + width] - sums[at]) * down[at] + width.astype(np.uint64))
    order = mix((sums[first + words] - sums[first]) * down[first] ^ mix(words.astype(np.uint64)))
    return Shingles(hashes, counts, words, order)


def in_slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as UTF-8) of runs of texts of about `most` bytes; null is empty."""
    begin, part, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > most:
            yield begin, part
            begin, part, size = k, [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield begin, part
