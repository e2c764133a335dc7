"""Vectorised words and rolling hashes of a batch of texts (numpy, inside Spark tasks).

A batch is joined to one byte string. Words are found by a byte table, hashed by a polynomial over
random byte values modulo 2**64 and mixed; a run of consecutive words is hashed the same way over the
words' hashes. Prefix sums make every window of any length cost two look-ups. The hashes depend on
nothing but the bytes, so all tasks and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def _mix_one(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


_BYTE = np.array([_mix_one(b + 1) for b in range(256)], np.uint64)
_PRIME = _mix_one(1001) | 1
_PRIME_WORDS = _mix_one(2002) | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: all but ASCII white space, or digits, lower-case letters and all beyond ASCII.
NOT_SPACE = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t))
        known = _powers[base] = (tables[0], tables[1])
        if size > 4 * CHUNK_BYTES:  # do not keep what one very long text needed
            _powers.pop(base)
    return known


class Sums:
    """Prefix sums from which the hash of any range of values follows."""

    def __init__(self, values: np.ndarray, base: int):
        up, self._down = _power_tables(base, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    """Words of some texts: byte ranges in data, index of the text, hash; first: word index where each text begins."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def words(texts: list[bytes], is_word: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, np.uint8)
    if lower:
        buf = _LOWER[buf]
        data = buf.tobytes()
    edge = np.flatnonzero(np.diff(is_word[buf].view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, begin)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, text, Sums(_BYTE[buf], _PRIME).range(start, end), first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of size words within one text."""
    n = len(w.hash)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n - size + 1)
    at = at[w.text[: n - size + 1] == w.text[size - 1 :]]
    return at, Sums(w.hash, _PRIME_WORDS).range(at, at + size)


def covered(n: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that begins at one of at."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into parts of at most limit bytes of text, or one row; with the texts as bytes (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
            part = batch.slice(i, j - i)
            yield part, pc.fill_null(part.column(text).cast(pa.binary()), b"").to_pylist()
            i = j


def per_text(w: Words, values: np.ndarray) -> np.ndarray:
    """Sums of a value of each word, by text."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[w.first])
