"""BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

Each task takes its documents in portions, collects the distinct words that it has not met,
walks their trie once (`word_trie`) and puts the documents' ids together from the words'.
Nothing is shuffled and no task depends on another. What a task keeps of words is bounded.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chunked import ChunkCache, portions
from tidewater.llm.word_trie import PIECE, SPACES, WordTrie, token_texts
from tidewater.session import bounded_batches

_tries: dict[str, WordTrie] = {}
_texts: dict[str, dict[int, str]] = {}
ROWS = 256
WIDTH = array("I").itemsize
MARKS = frozenset(".,;:!?|")


def _trie(path: str) -> WordTrie:
    if path not in _tries:
        _tries[path] = WordTrie(path)
    return _tries[path]


def pieces_of(chunk: str) -> list[str]:
    """What BPE takes one by one; words of letters, with or without a mark at the end, need no pattern."""
    if chunk.isascii() and chunk.isprintable():
        low = chunk.lower()
    else:
        low = normal(chunk)
    if low.isalpha():
        return [low]
    if low[-1:] in MARKS and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return PIECE.findall(low)


def normal(chunk: str) -> str:
    """NFC, white space to one blank, letters lower-cased each for itself."""
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk)
    chunk = SPACES.sub(" ", chunk)
    return "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()


class TrieEncoder:
    """Ids of chunks: special tokens, then pieces, then words over the trie."""

    def __init__(self, trie: WordTrie, most: int = 200_000):
        self.trie, self.most = trie, most
        self.pieces: dict[str, bytes] = {}

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, list[int]]:
        cut: list[list[str | int]] = []
        for chunk in chunks:
            if "<|" in chunk and self.trie.special_re:
                parts: list[str | int] = []
                for k, part in enumerate(self.trie.special_re.split(chunk)):
                    parts += [self.trie.special[part]] if k % 2 else pieces_of(part)
                cut.append(parts)
            else:
                cut.append(pieces_of(chunk))
        wanted = {p for parts in cut for p in parts if isinstance(p, str)}
        new = wanted - self.pieces.keys()
        if len(self.pieces) + len(new) > self.most:
            self.pieces, new = {}, wanted
        letters = self.trie.letters
        spelt = {"".join([letters[b] for b in p.encode()]): p for p in new}
        for word, ids in self.trie.encode_words(list(spelt)).items():
            self.pieces[spelt[word]] = array("I", ids).tobytes()
        raw = [b"".join([array("I", (p,)).tobytes() if isinstance(p, int) else self.pieces[p] for p in parts]) for parts in cut]
        return np.frombuffer(b"".join(raw), dtype=np.uintc), [len(x) // WIDTH for x in raw]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(TrieEncoder(_trie(path)))  # a task's own: workers live on and would keep it
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                keep = [x for x in part.schema.names if x != "text"]
                for a, b in portions(texts):
                    ids = pa.array(cache.encode(texts[a:b]), type=pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(x).slice(a, b - a) for x in keep), ids], names=[*keep, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _texts:
            _texts[path] = _tries[path].text if path in _tries else token_texts(path)
        text = _texts[path]
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                said = [" ".join(map(text.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, type=pa.string())], names=[*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids): the ids as little-endian unsigned 32-bit integers.

    `path` names a vocabulary file that every executor can read. Special tokens in a text
    are met as such; none is added. Null texts count as empty and have no ids; repeated and
    null doc_ids are kept as they are; other columns are ignored. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> with decoded: the tokens' texts with a blank between them, as a vocabulary without a decoder gives them."""
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are decoded by the worker that made them, so a task needs one worker, not two.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    to_ids, to_text = _encode(path), _decode(path)
    both = docs.select("doc_id", "text").mapInArrow(lambda batches: to_text(to_ids(batches)), f"doc_id {kind}, ids binary, decoded string")
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
