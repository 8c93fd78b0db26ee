"""N-gram Jaccard join: MinHash bands propose, full shingle sets decide.

Words are the lower-cased runs between white space; a shingle is five words in a row (a
shorter text is one shingle). Two documents are linked if the Jaccard similarity of their
shingle sets is at least `threshold`.

1. Documents with the same shingle set form a node, named by a 128-bit digest of the set;
   only nodes go on, so copies cost nothing further.
2. `plan_bands` picks the fewest hashes whose bands miss a pair at the threshold with a
   chance of at most `miss`. Rows (band hash, node, sketch) are shuffled by band hash; the
   sketch holds one bit of each MinHash, so two members of a bucket are candidates if so
   many bits agree as a pair at the threshold has but with chance `miss` (`plan_sketch`).
   A bucket gives a spanning forest of its candidates, never its pairs. Buckets of many
   members are shared out over tasks in blocks of parts two by two.
3. Candidates are alike already, so their components are about as large as the classes.
   The shingle sets of a component meet in blocks bounded in members and in bytes. There
   all intersections are counted exactly; what leaves a block are counts of links by
   node and a spanning forest of verified links.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytestext as B
from tidewater.llm.components import components
from tidewater.llm.rows import MAX_BROADCAST_ROWS, row_key, small
from tidewater.session import Scratch, bounded_batches, columns_of

U32, U64 = np.uint32, np.uint64
#: Members of a bucket that one part of it has, about; and bytes of shingles that one part of a component has.
BUCKET_PART = 4_096
PART_BYTES = 24 << 20
SKETCH_BYTES = 32


def plan_bands(threshold: float, miss: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that miss a pair at the threshold with chance `miss` at most."""
    caught = threshold**rows
    return int(np.ceil(np.log(miss) / np.log1p(-caught))), rows


def plan_sketch(threshold: float, hashes: int, miss: float) -> int:
    """The most bits, of one for each hash, in which a pair at the threshold differs but with chance `miss` at most."""
    p = (1 - threshold) / 2  # a bit differs if the hashes do, and then half the time
    tail, most = 1.0, -1
    while tail > miss and most < hashes:
        most += 1
        tail -= math.comb(hashes, most) * p**most * (1 - p) ** (hashes - most)
    return most


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = B.mix(np.arange(1, 2 * count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (seeds[:count] | U64(1)).astype(U32), seeds[count:].astype(U32)


def _band_hashes(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of band hashes, and a sketch, for each text that has shingles."""
    odd, flip = _hashers(bands * rows)
    x = (values >> U64(32)).astype(U32)
    begins = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(begins), bands), dtype=U64)
    bits = np.zeros((len(begins), 8 * SKETCH_BYTES), dtype=np.uint8)
    for b in range(bands):
        acc = np.full(len(begins), b + 1, dtype=U64)
        for k in range(b * rows, (b + 1) * rows):
            h = (x ^ flip[k]) * odd[k]
            h ^= h >> U32(15)
            h *= U32(0x2C1B3C6D)
            least = np.minimum.reduceat(h, begins)
            acc = B.mix(acc * U64(0x9E3779B97F4A7C15) + least.astype(U64))
            if k < 8 * SKETCH_BYTES:
                bits[:, k] = least & U32(1)
        out[:, b] = acc
    return out, np.packbits(bits, axis=1)


def _fixed(raw: bytes, n: int, width: int) -> pa.Array:
    """A binary array of n values of one width."""
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1])
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(raw)])


def _unfixed(col: pa.Array, width: int) -> np.ndarray:
    """The bytes (n x width) of a binary array whose values all have this width."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(col), width)


SIGNED = "key binary, digest binary, n_shingles long, sketch binary, bands array<long>"


def _signatures(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in B.runs(batch.column("text"), B.NOT_SPACE):
                values, first = B.distinct_within(*B.shingle_hashes(words, size))
                count = np.diff(first)
                has = count > 0
                n = int(has.sum())
                ids, keys = (batch.column(c).slice(a, b - a).filter(pa.array(has)) for c in ("doc_id", "key"))
                if n:
                    begins = first[:-1][has]
                    sums = np.add.reduceat(B.mix(values ^ U64(0xA5A5A5A5)), begins)
                    again = np.add.reduceat(B.mix(values + U64(0x1234567)), begins)
                    digest = np.column_stack([sums, again]).astype("<u8").tobytes()
                    sig, sketch = _band_hashes(values, first, bands, rows)
                    sig, sketch = sig.view(np.int64), sketch.tobytes()
                else:
                    digest, sig, sketch = b"", np.zeros((0, bands), dtype=np.int64), b""
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(sig.ravel()))
                cols = [ids, keys, _fixed(digest, n, 16), pa.array(count[has]), _fixed(sketch, n, SKETCH_BYTES), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "digest", "n_shingles", "sketch", "bands"])

    return run


def _candidates(far: int):
    """Rows come sorted by (h, b0, b1); gives edges (u, v) of a spanning forest of each block's candidates."""

    def block(sketch: np.ndarray) -> tuple[list[int], list[int]]:
        u: list[int] = []
        v: list[int] = []
        left = np.arange(len(sketch))
        while len(left) > 1:
            wave, left = [int(left[0])], left[1:]
            while wave and len(left):
                x = wave.pop()
                close = np.bitwise_count(sketch[left] ^ sketch[x]).sum(axis=1) <= far
                hit = left[close].tolist()
                left = left[~close]
                u += [x] * len(hit)
                v += hit
                wave += hit
        return u, v

    def edges(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        count = np.diff(np.r_[begins, len(key)])
        two = begins[count == 2]
        two = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1) <= far]
        us, vs = [two], [two + 1]
        for at, n in zip(begins[count > 2].tolist(), count[count > 2].tolist()):
            u, v = block(sketch[at : at + n])
            us.append(np.array(u, dtype=np.int64) + at)
            vs.append(np.array(v, dtype=np.int64) + at)
        u, v = np.concatenate(us), np.concatenate(vs)
        return node[u], node[v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(parts):
            if parts:
                u, v = edges(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([_fixed(x.tobytes(), len(x), 16) for x in (u, v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h", "b0", "b1")])
            rows = key, _unfixed(batch.column("digest"), 16), _unfixed(batch.column("sketch"), SKETCH_BYTES).view(U64)
            open_ = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])[-1])  # the last block may go on in the next batch
            if held and (key[0] != held[-1][0][-1]).any():
                yield from emit(held)
                held = []
            if open_:
                yield from emit([*held, tuple(x[:open_] for x in rows)])
                held = []
            held.append(tuple(x[open_:] for x in rows))
        yield from emit(held)

    return run


SETS = ["comp", "part", "blocks", "copies", "node"]


def _sets(size: int):
    """Rows with text -> with the shingle set in its place; a node that a task has met is not given again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            new = pa.array([n not in seen and not seen.add(n) for n in nodes], pa.bool_())
            batch = batch.filter(new)
            for a, b, words in B.runs(batch.column("text"), B.NOT_SPACE):
                values, first = B.distinct_within(*B.shingle_hashes(words, size))
                raw = values.astype("<u8").tobytes()
                sets = pa.array([raw[i * 8 : j * 8] for i, j in zip(first[:-1].tolist(), first[1:].tolist())], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in SETS), sets], names=[*SETS, "shingles"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of one block, from the shingles that at least two of them hold."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.int64)
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    count = np.diff(np.r_[begins, len(values)])
    wide = count > max(2, m // 16)
    for lo in range(0, int(wide.sum()), 4096):  # shingles of many members: a dense product
        b, c = begins[wide][lo : lo + 4096], count[wide][lo : lo + 4096]
        at = np.repeat(b - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
        x = np.zeros((m, len(b)), dtype=np.float32)
        x[owner[at], np.repeat(np.arange(len(b)), c)] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    few = (count > 1) & ~wide
    for c in np.unique(count[few]):  # the others: their pairs, size by size
        b = begins[few & (count == c)]
        members = owner[b[:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        step = max(1, (1 << 21) // len(i))
        for lo in range(0, len(b), step):
            code = (members[lo : lo + step, i] * m + members[lo : lo + step, j]).ravel()
            found = np.bincount(code, minlength=m * m).reshape(m, m) if m * m < 1 << 16 else None
            if found is None:
                keys, times = np.unique(code, return_counts=True)
                found = np.zeros((m, m), dtype=np.int64)
                found.ravel()[keys] = times
            out += found + found.T
    return out


VERIFIED = "u binary, v binary, links long"


def _verify(threshold: float):
    """Rows come sorted by (comp, block); gives (u, v, 0) for the edges of a spanning forest and (u, null, links) for the copies linked to u."""

    def block(ids, copies, part, home, sets) -> tuple[list, list, list]:
        size = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if home[0] != home[1]:  # pairs within one of the two parts are counted in its own block
            linked &= part[:, None] != part[None, :]
        total = linked @ copies
        some = np.flatnonzero(total > 0).tolist()
        u, v, w = [ids[i] for i in some], [None] * len(some), total[some].tolist()
        todo = np.ones(len(ids), dtype=bool)
        while todo.any():
            wave = [int(np.argmax(todo))]
            todo[wave[0]] = False
            while wave:
                x = wave.pop()
                new = np.flatnonzero(linked[x] & todo)
                todo[new] = False
                wave += new.tolist()
                u += [ids[x]] * len(new)
                v += [ids[i] for i in new.tolist()]
                w += [0] * len(new)
        return u, v, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            if len(held) > 1:
                ids, copies, part, raw = zip(*held)
                for to, more in zip(out, block(ids, np.array(copies), np.array(part), key[1:], [np.frombuffer(r, dtype="<u8") for r in raw])):
                    to.extend(more)
            held.clear()

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int64()))], names=["u", "v", "links"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            cols = batch.to_pydict()
            for k in zip(cols["comp"], cols["b0"], cols["b1"], cols["node"], cols["copies"], cols["part"], cols["shingles"]):
                if k[:3] != key:
                    flush()
                    key = k[:3]
                if not held or held[-1][0] != k[3]:  # repeats of one row may come from several tasks
                    held.append(k[3:])
            if len(out[0]) > 20_000:
                yield emit()
        flush()
        yield emit()

    return run


def _classes(docs: DataFrame, scratch: Scratch, threshold: float, size: int, miss: float, block: int, bucket_part: int) -> DataFrame:
    """(doc_id, key, class_node, class_id, copy_of, n_copies, n_links) of the rows whose texts have words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = plan_bands(threshold, miss)
    far = plan_sketch(threshold, min(bands * rows, 8 * SKETCH_BYTES), miss)
    text = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.lower("text").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    signed = scratch.keep(text.mapInArrow(_signatures(bands, rows, size), f"doc_id {kind}, {SIGNED}"), "signed")
    same = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.min("key").alias("key"), *same)
    nodes = scratch.keep(nodes, "nodes")
    banded = nodes.select("digest", "sketch", F.explode("bands").alias("h"))
    large = banded.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > bucket_part)
    large = scratch.keep(large.select("h", F.ceil(F.col("n") / bucket_part).cast("int").alias("blocks")), "large_buckets")
    dealt = banded.join(small(large), "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("part", "o").alias("b0"), F.greatest("part", "o").alias("b1"), "digest", "sketch")
    dealt = dealt.repartition("h", "b0", "b1").sortWithinPartitions("h", "b0", "b1")
    ties = scratch.keep(dealt.mapInArrow(_candidates(far), "u binary, v binary"), "ties")
    comps = components(ties, scratch, "ties")
    members = comps.join(nodes.select(F.col("digest").alias("node"), F.col("n_copies").alias("copies"), "n_shingles", "key"), "node")
    members = scratch.keep(members, "members")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") * 8 / PART_BYTES)).cast("int").alias("blocks"))
    parts = members.join(sizes, "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    parts = scratch.keep(parts.select("key", *SETS), "parts")
    short = F.xxhash64("key").alias("short")  # so that few other texts are shuffled to meet their parts
    near = text.select("key", "text", short).join(small(parts.select(short), 4 * MAX_BROADCAST_ROWS), "short", "left_semi")
    sets = near.join(small(parts, MAX_BROADCAST_ROWS // 4), "key").select(*SETS, "text").mapInArrow(_sets(size), "comp binary, part int, blocks int, copies long, node binary, shingles binary")
    met = (
        sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("part", "o").alias("b0"), F.greatest("part", "o").alias("b1"), "node", "copies", "part", "shingles")
        .repartition("comp", "b0", "b1")
        .sortWithinPartitions("comp", "b0", "b1", "node")
    )
    found = scratch.keep(met.mapInArrow(_verify(threshold), VERIFIED), "found")
    counts = found.where("v is null").groupBy(F.col("u").alias("digest")).agg(F.sum("links").alias("links"))
    classes = components(found.where("v is not null").select("u", "v"), scratch, "links").withColumnRenamed("node", "digest")
    named = classes.join(nodes.select("digest", "copy_of"), "digest")
    named = named.join(named.groupBy("comp").agg(F.min("copy_of").alias("class_id")), "comp").join(counts, "digest", "left")
    named = scratch.keep(named.select("digest", "comp", "class_id", "links"), "named")
    linked = F.col("comp").isNotNull()
    told = nodes.select("digest", "copy_of", "n_copies").join(named, "digest", "left").select(
        "digest", F.coalesce("comp", "digest").alias("class_node"), F.when(linked, F.col("class_id")).otherwise(F.col("copy_of")).alias("class_id"), "copy_of", "n_copies",
        (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return signed.select("doc_id", "key", "digest").join(told, "digest").drop("digest")


def jaccard_classes(docs: DataFrame, scratch: Scratch, threshold: float = 0.8, size: int = 5, miss: float = 1e-7, block: int = 1024, bucket_part: int = BUCKET_PART) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, class_id, copy_of, n_copies, n_links), one row per document.

    class_id: least doc_id of the documents joined by links; copy_of: least doc_id with the
    same shingle set; n_copies: documents with that set; n_links: other documents whose
    similarity to this one is `threshold` or more.

    Every row is a document of its own, repeated and null doc_ids too; doc_ids may be of any
    type that has an order, and null is no least one unless there is no other. Null or blank
    texts have no shingles: each is a class of its own, without links. Other columns are
    ignored, whatever their names. No rows: no rows.
    """
    linked = _classes(docs, scratch, threshold, size, miss, block, bucket_part).drop("key", "class_node")
    blank = docs.where("text is null or not regexp_like(text, '[^\\\\t\\\\n\\\\x0B\\\\f\\\\r ]')").select("doc_id")
    alone = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, scratch: Scratch, threshold: float = 0.8, size: int = 5, miss: float = 1e-7, block: int = 1024, bucket_part: int = BUCKET_PART) -> DataFrame:
    """docs without near duplicates: of each class one row stays, the one with the least doc_id (null last).

    Rows are told apart by doc_id and text together: of a repeated row one stays, a row that
    only shares its doc_id with a duplicate is not touched. Of repeats that differ in other
    columns any one stays. Rows with null or blank texts all stay. No rows: no rows.
    """
    many = _classes(docs, scratch, threshold, size, miss, block, bucket_part).where("n_links > 0")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    many = scratch.keep(many.select("class_node", "key", order.alias("o")), "many")
    leads = many.groupBy("class_node").agg(F.min("o").alias("lead"))
    marks = many.groupBy("class_node", "key").agg(F.min("o").alias("o"), F.count("*").alias("times")).join(leads, "class_node")
    name = f"key_{uuid.uuid4().hex}"
    marks = scratch.keep(marks.select(F.col("key").alias(name), (F.col("o") == F.col("lead")).alias("leads"), "times"), "marks")
    marked = marks.where("not leads or times > 1").select(name)
    short = f"short_{uuid.uuid4().hex}"  # few texts are shuffled: most show by 64 bits of their key that they are not marked
    rows = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text"))).withColumn(short, F.xxhash64(name))
    hints = small(marked.select(F.xxhash64(name).alias(short)), 4 * MAX_BROADCAST_ROWS)
    columns = columns_of(docs)
    close = rows.join(hints, short, "left_semi")
    repeated = marks.where("leads and times > 1").select(name)
    kept = rows.join(hints, short, "left_anti").select(*columns).union(close.join(small(marked), name, "left_anti").select(*columns))
    if repeated.isEmpty():
        return kept
    one = close.join(repeated, name, "left_semi").groupBy(name).agg(F.first(F.struct(*columns)).alias("row"))
    return kept.union(one.select("row.*"))
