"""Token ids of a corpus in compressed files, in ascending doc_id order, and back.

1. Documents are dealt out by ranges of doc_id, sorted and tokenised; each task also
   counts its ids. Ids (16 bits each where the vocabulary allows) and counts are kept.
2. Counts are summed over all tasks: one frequency table for all blocks, as large as the
   vocabulary, sent to every task.
3. Each task codes its documents into blocks of whole documents (`rans`). A row of the
   file format is one block with its documents' ids and lengths; Parquet files hold the
   rows, so writes are atomic and a lost task is done again by itself.
4. Reading back, blocks are decoded independently of each other. Where a range's first id
   stands follows from the ranges' totals, one number each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.chunked import ChunkCache, portions
from tidewater.llm.rans import Table, decode_block, encode_block, scaled
from tidewater.llm.rows import long_ids
from tidewater.session import Scratch, bounded_batches

_caches: dict[tuple[str, str], ChunkCache] = {}

BLOCK_IDS = 1 << 18
GROUP = 10_000
PLAIN = re.compile(r"""[a-zß-öø-ÿ]+[!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*""")  # neither apostrophes (endings) nor < (special tokens)
STAGED = ["part", "at", "doc_id", "ids", "counts"]
BLOCK = "part int, base long, doc_ids array<long>, lengths array<int>, body binary"


def _library(path: str, dtype: str) -> ChunkCache:
    """Ids of chunks by the tokenizers library."""
    if (path, dtype) not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        mark = "\x01"  # a chunk of its own between chunks; where it is not one id, or stands in a chunk, chunks go one by one
        marked = tokenizer.encode(f"a {mark} a", add_special_tokens=False).ids
        alone = len(marked) == 3 and marked[0] == marked[2] != marked[1]

        closes = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])
        tried = tokenizer.encode_batch_fast(["a", "b.", "é.,", "ab!? ß*"], add_special_tokens=False)
        pieces = [int(closes[e.ids].sum()) for e in tried]
        plain = PLAIN if pieces == [1, 2, 2, 4] else re.compile("(?!)")  # letters and a run of marks are a piece each, and its last id closes it

        def encode_plain(group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
            """Words of letters, with marks at their ends or none, as one text; each ends where its pieces' last id closes one."""
            (found,) = tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)
            ids = np.array(found.ids, dtype=np.int64)
            ends = np.flatnonzero(closes[ids]) + 1
            last = np.cumsum([1 + (not c.isalpha()) for c in group]) - 1
            return (ids, np.diff(ends[last], prepend=0)) if len(ends) == last[-1] + 1 else None

        def encode_marked(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Any chunks as one text, with a mark between them that no other chunk has."""
            if not alone or any(mark in c for c in group):
                found = [e.ids for e in tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                return np.array([i for f in found for i in f], dtype=np.int64), np.array([len(f) for f in found])
            (found,) = tokenizer.encode_batch_fast([f" {mark} ".join(group)], add_special_tokens=False)
            ids = np.array(found.ids, dtype=np.int64)
            cuts = np.flatnonzero(ids == marked[1])
            return np.delete(ids, cuts), np.diff(np.r_[-1, cuts, len(ids)]) - 1

        def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            is_plain = np.array([plain.fullmatch(c) is not None for c in chunks])
            order = np.argsort(~is_plain, kind="stable")
            flat, sizes = [], []
            for places, encode in ((order[: is_plain.sum()], encode_plain), (order[is_plain.sum() :], encode_marked)):
                for a in range(0, len(places), GROUP):
                    group = [chunks[i] for i in places[a : a + GROUP].tolist()]
                    ids, size = encode(group) or encode_marked(group)
                    flat.append(ids)
                    sizes.append(size)
            size = np.concatenate(sizes)
            begin, back = np.cumsum(size) - size, np.argsort(order)
            begin, size = begin[back], size[back]  # as the chunks were given
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            return np.concatenate(flat)[at], size

        _caches[path, dtype] = ChunkCache(encode_new, dtype, most=900_000)
    return _caches[path, dtype]


def _tokenise(path: str, end_id: int, size: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = _library(path, dtype), TaskContext.get().partitionId()
        counts = np.zeros(size, dtype=np.int64)
        at = 0
        end = np.array([end_id], dtype=dtype).tobytes()
        width = len(end)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions(texts):
                raw = [x + end for x in cache.encode(texts[a:b])]
                counts += np.bincount(np.frombuffer(b"".join(raw), dtype=dtype), minlength=size)
                n = b - a
                ends = at + np.cumsum([len(x) // width for x in raw])
                places = np.r_[at, ends[:-1]]
                at = int(ends[-1])
                cols = [pa.array([part] * n, pa.int32()), pa.array(places), batch.column("doc_id").slice(a, n), pa.array(raw, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=STAGED)
        cols = [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()])]
        yield pa.RecordBatch.from_arrays(cols, names=STAGED)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            one = np.frombuffer(raw, dtype="<i8")
            total = one.copy() if total is None else total + one
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _encode(parts: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(parts)
        width = np.dtype(dtype).itemsize
        key, docs, held, size = None, [], [], 0  # key: range and place of the block's first id

        def flush():
            nonlocal size
            body = encode_block(np.frombuffer(b"".join(held), dtype=dtype), table)
            row = [[key[0]], [key[1]], [list(docs)], [[len(h) // width for h in held]], [body]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            size = 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "base", "doc_ids", "lengths", "body"])

        for batch in batches:
            for p, at, d, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "ids"))):
                if held and (size >= BLOCK_IDS or (p, at) != (key[0], key[1] + size)):  # a task may be given pieces of several ranges
                    yield flush()
                if not held:
                    key = (p, at)
                docs.append(d)
                held.append(raw)
                size += len(raw) // width
        if held:
            yield flush()

    return run


def _read(parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(parts)
        for batch in batches:
            for part, base, docs, lengths, body in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "doc_ids", "lengths", "body"))):
                raw = decode_block(body, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = (base + ends - lengths).tolist()
                ids = [raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
                crc = [zlib.crc32(x) for x in ids]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                row = [[part] * len(docs), docs, starts, lengths, crc, ids]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def write(docs: DataFrame, path: str, out: str, scratch: Scratch, end_id: int = 1, vocab_size: int = 49_408) -> None:
    """Writes docs(doc_id, text, ...) to the folder `out`: blocks, and table (id, parts).

    Null texts count as empty and have the end id alone. Null doc_ids come first; rows with
    one doc_id are in order of a hash of their texts. Other columns are ignored. No rows: no blocks.
    doc_ids are whole numbers; any other type is a TypeError.
    """
    bounded_batches(docs.sparkSession)
    size = max(vocab_size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    ranged = docs.select(long_ids(docs, "doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    staged = ranged.select("doc_id", "text").mapInArrow(_tokenise(path, end_id, size, dtype), "part int, at long, doc_id long, ids binary, counts binary")
    staged = scratch.keep(staged, "staged")
    counts = staged.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    vector = np.zeros(size, dtype=np.int64)
    for r in counts.collect():  # a row for each id of the vocabulary at most
        vector[r["id"]] = r["n"]
    parts = scaled(vector)
    spark = docs.sparkSession
    at = np.flatnonzero(parts)
    spark.createDataFrame([(int(i), int(parts[i])) for i in at], "id int, parts int").coalesce(1).write.parquet(f"{out}/table")
    ids = staged.where("ids is not null").select("part", "at", "doc_id", "ids")
    ids.mapInArrow(_encode(parts, dtype), BLOCK).write.option("compression", "none").parquet(f"{out}/blocks")
    scratch.drop("staged")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The documents of a folder that `write` made: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit). Damaged blocks raise an error."""
    listed = spark.read.parquet(f"{out}/table").collect()
    size = max((r["id"] for r in listed), default=0) + 1
    parts = np.zeros(size, dtype=np.int64)
    for r in listed:
        parts[r["id"]] = r["parts"]
    blocks = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    ranges = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, placed = 0, []
    for r in ranges.orderBy("part").collect():  # a number for each range
        placed.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(placed, "part int, before long"))
    local = blocks.mapInArrow(_read(parts), "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return local.join(offsets, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids")
