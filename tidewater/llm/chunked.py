"""Token ids of whole texts from the ids of their space-separated chunks.

The tokenizer composes and lower-cases letters, drops white space, and no rule of its looks across it, so the ids of a text
are those of its chunks one after another. Chunks are cut at plain white space only; any
other stays within a chunk and is left to the encoder. A cache keeps the ids of chunks
seen; it starts anew beyond `most`, so a task's memory is bounded whatever its vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def folded(text: str) -> str:
    """Lower-cased where a tokenizer that composes (NFC) and lower-cases each letter gives the same ids for it; else as it is."""
    if "<|" in text:
        return text
    if text.isascii():
        return text.lower()
    low = text.lower()
    same = "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
    return low if same else text


def spaced(text: str) -> str:
    return folded(text).replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _strings(chunks: pa.Array) -> list[str]:
    """Strings without blanks as a list; one string that is split comes much faster than one after another."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
    return pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(chunks) else []


class ChunkCache:
    """encode_new: distinct chunks -> the ids of all of them in a row, and how many each has. Ids are kept as little-endian bytes of `dtype`."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[Sequence[int], Sequence[int]]], dtype: str = "<u4", most: int = 200_000):
        self.encode_new, self.dtype, self.most = encode_new, dtype, most
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Arrow cuts the texts and tells chunks apart, so that each distinct one is looked up once."""
        cut = pc.split_pattern(pa.array([spaced(t or "") for t in texts], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        distinct = _strings(coded.dictionary)
        ids = list(map(self.known.get, distinct))
        new = [c for c, i in zip(distinct, ids) if i is None]
        if new:
            if len(self.known) + len(new) > self.most:
                self.known = {"": b""}
                new = [c for c in distinct if c]
            listed = sorted(new)
            flat, sizes = self.encode_new(listed)
            raw = np.asarray(flat, dtype=self.dtype).tobytes()
            ends = np.cumsum(np.asarray(sizes, dtype=np.int64) * np.dtype(self.dtype).itemsize).tolist()
            self.known.update(zip(listed, (raw[a:b] for a, b in zip([0, *ends], ends))))
            ids = [self.known[c] if i is None else i for c, i in zip(distinct, ids)]
        each = list(map(ids.__getitem__, coded.indices.to_numpy().tolist()))
        ends = cut.offsets.to_numpy().tolist()
        return [b"".join(each[a:b]) for a, b in zip(ends, ends[1:])]


def portions(texts: list[str | None], most: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Cuts a list of texts into runs of whole texts of about `most` letters."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
