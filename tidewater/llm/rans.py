"""Static range asymmetric numeral coding of token ids in independent, interleaved blocks.

One frequency table (2**20 parts) serves all blocks. A block codes its ids over `lanes`
states in turn: id number t * lanes + k belongs to lane k. States are 64-bit in
[2**31, 2**63) and move 32-bit words. Every `every` steps there is a checkpoint: the
states and the place in the words; decoding can start at each, and `decode_block` does so
at all of them at once. Each stretch of words has its CRC-32.

Block bytes, little-endian: magic 'TWR1', then unsigned 32-bit lanes, ids, steps between
checkpoints, stretches; per stretch its number of words and CRC-32; per stretch its lanes'
states (64-bit); the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U32, U64 = np.uint32, np.uint64
SCALE = 20
LOW = U64(1 << 31)
MAGIC = b"TWR1"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts to parts of 2**20, one at least for each id that occurs; all zero where nothing occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    whole = 1 << SCALE
    if np.count_nonzero(counts) > whole:
        raise ValueError("more ids than the table has parts")
    parts = np.where(counts > 0, np.maximum(1, (counts * (whole / total)).astype(np.int64)), 0)
    rest = whole - int(parts.sum())
    order = np.lexsort((np.arange(len(parts)), -parts))
    while rest:
        some = order[parts[order] > (1 if rest < 0 else 0)][: abs(rest)]
        parts[some] += 1 if rest > 0 else -1
        rest = whole - int(parts.sum())
    return parts


class Table:
    """Parts of the ids, where each begins, and the id of each part."""

    def __init__(self, parts: np.ndarray):
        self.freq = np.asarray(parts, dtype=U64)
        self.base = (np.cumsum(self.freq) - self.freq).astype(U64)
        self.slot = np.repeat(np.arange(len(parts), dtype=U32), np.asarray(parts, dtype=np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = 1024, every: int = 64) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 32))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=U64)
    freq, base = table.freq[ids], table.base[ids]
    if n and not freq.all():
        raise ValueError("an id without a place in the table")
    limit = freq << U64(63 - SCALE)
    stretches, words = [], []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        f = freq[a:b]
        full = x >= limit[a:b]
        out = x[full]
        words.append(out.astype(U32))
        x[full] = out >> U64(32)
        q = x // f
        x[:] = (q << U64(SCALE)) + (x - q * f) + base[a:b]
        if t % every == 0:
            run = np.concatenate(words[::-1]) if words else np.zeros(0, U32)
            stretches.append((run.astype("<u4").tobytes(), state.astype("<u8").tobytes()))
            words = []
    stretches.reverse()
    head = MAGIC + struct.pack("<4I", lanes, n, every, len(stretches))
    marks = b"".join(struct.pack("<2I", len(w) // 4, zlib.crc32(w)) for w, _ in stretches)
    return head + marks + b"".join(s for _, s in stretches) + b"".join(w for w, _ in stretches)


def decode_block(block: bytes, table: Table) -> np.ndarray:
    """The ids of a block; ValueError where it is damaged."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    lanes, n, every, count = struct.unpack_from("<4I", block, 4)
    if not count:
        return np.zeros(0, dtype=U32)
    at = 20
    marks = np.frombuffer(block, dtype="<u4", count=2 * count, offset=at).reshape(count, 2).astype(np.int64)
    at += 8 * count
    state = np.frombuffer(block, dtype="<u8", count=count * lanes, offset=at).reshape(count, lanes).copy()
    at += 8 * count * lanes
    begins = np.cumsum(marks[:, 0]) - marks[:, 0]
    if len(block) != at + 4 * int(marks[:, 0].sum()):
        raise ValueError("a block of another length than it says")
    for b, (size, crc) in zip(begins, marks):
        if zlib.crc32(block[at + 4 * b : at + 4 * (b + size)]) != crc:
            raise ValueError("a block's words don't match their checksum")
    words = np.append(np.frombuffer(block, dtype="<u4", offset=at), np.zeros(1, "<u4")).astype(U64)
    out = np.zeros((count * every, lanes), dtype=U32)
    place = begins.copy()
    low = U64((1 << SCALE) - 1)
    for j in range(every):
        step = np.arange(count) * every + j
        live = (step[:, None] * lanes + np.arange(lanes)) < n
        if not live.any():
            break
        part = state & low
        ids = table.slot[part.astype(np.int64)]
        new = table.freq[ids] * (state >> U64(SCALE)) + part - table.base[ids]
        short = (new < LOW) & live
        rank = np.cumsum(short, axis=1)
        if short.any():
            new[short] = new[short] << U64(32) | words[(place[:, None] + rank - 1)[short]]
        place += rank[:, -1]
        np.copyto(state, new, where=live)
        out[step] = ids
    return out.ravel()[:n]
