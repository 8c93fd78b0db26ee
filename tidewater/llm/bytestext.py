"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
BATCH_BYTES = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, BATCH_BYTES + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * BATCH_BYTES:
            _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of a run of texts. start/end: byte places of each word; first: index of each text's first word, with one more at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = is_word[data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        before[cut] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        last = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= n)] - 1
        after[last] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[start:end] for many spans at once, the same wherever the bytes stand."""
        if self._sums is None:
            n = len(self.data)
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * _power(_BASE, n)[:n], out=sums[1:])
            self._sums = sums
        raw = (self._sums[end] - self._sums[start]) * _power(_BASE_INV, len(self.data))[start]
        return mix(raw + (end - start).astype(U64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = True
WORD_BYTES[128:] = True


def runs(texts: pa.Array, is_word: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Cuts a string array into runs of whole texts of about `most` bytes; yields (first row, end row, words). Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        a, b = int(offsets[row]), int(offsets[end])
        yield row, end, Words(data[a:b], offsets[row : end + 1] - a, is_word)
        row = end


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams in order, and where each text's begin. A text of fewer words has one shingle of all its words; one without words has none."""
    wh = words.hashes()
    count = np.diff(words.first)
    n = len(wh)
    mult = [U64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(size)]
    per_text = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(per_text, out=first[1:])
    rolled = np.zeros(max(n - size + 1, 0), dtype=U64)
    for k in range(size):
        rolled += wh[k : n - size + 1 + k] * mult[k] if n >= size else U64(0)
    out = np.zeros(first[-1], dtype=U64)
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], per_text)
    long = np.repeat(count >= size, per_text)
    out[long] = rolled[at[long]]
    for t in np.flatnonzero((count > 0) & (count < size)):
        w = wh[words.first[t] : words.first[t + 1]]
        acc = 0
        for k, x in enumerate(w):
            acc = (acc + int(x) * int(mult[k])) & (2**64 - 1)
        out[first[t]] = U64(acc ^ len(w))
    return mix(out), first


def distinct_within(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and where each text's begin."""
    if not len(values):
        return values, first
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(first)))
