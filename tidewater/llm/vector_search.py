"""Exact top-k by inner product: three phases with a uniform threshold.

The dimensions are cut into slices; a node is one slice of one chunk of candidates, and its
local scores are the parts of the inner products that its dimensions give. Queries are a
stated set, packed in chunks; so many of them as fit in `PASS_BYTES` are broadcast to the
nodes at a time, and the candidates are neither copied nor shuffled to meet them.

1. Gather. Each node lists for each query its k best local scores. Of all lists of a slice
   the best `HEADS` * k are resolved exactly; the k-th best of their scores is a safe cutoff
   t of the query: its answer holds no score below t.
2. Collect. t is broadcast. What reaches t has in one slice at least a local score of
   t / slices: the same share for all nodes. Only entries of at least the share are sent.
3. Resolve. Entries of all slices add up to exact scores, whose k-th best may raise t; where
   a slice is missing, the rest is below the share, and candidates that fall short of t
   even so go. The missing parts of the others are fetched from their nodes. Where more
   than `DENSE` entries of a node reach a query's share, as in a group of near copies, the
   node sends a mark instead, and the chunk's scores for that query are added up in place:
   what is sent grows with chunks, not with the square of a group.

Of equal vectors only the k + 1 with the smallest vec_ids are candidates: any other has k
others of its score before it. Components too large for exact sums in doubles are worked
out in whole numbers of any size (`_wide`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.rows import long_ids
from tidewater.session import Scratch, bounded_batches

CHUNK = 4_096
CHUNK_BYTES = 4 << 20
QUERIES = 512
PASS_BYTES = 32 << 20
SLICES = 2
HEADS = 4
DENSE = 64
EXACT = float(1 << 53)
PAIR = ["dims", "q", "qi", "chunk", "ci"]
ENTRY = "dims int, q long, qi int, slice int, chunk long, ci int, vec_id long, local long"


def usable(embedding: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def _dense(v: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(v).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, v.astype(kind).tobytes()


def _opened(kind: str, body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, kind).astype(np.float64).reshape(n, -1)


PACKED = "dims int, q long, chunk long, ids binary, rids binary, parts array<struct<kind:string,body:binary>>"


def _pack(rows: int, slices: int):
    """Rows (dims, q, vec_id, rid, x) in order of (dims, q) -> chunks of one dims and q, each with its slices; slices = 0 keeps x as it is, whole; rows = 0 makes one chunk of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            ids, rids, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            cap = max(1, min(rows, CHUNK_BYTES // (8 * key[0]))) if rows else len(ids)
            for a in range(0, len(ids), cap):
                part = x[a : a + cap]
                cuts = np.linspace(0, key[0], max(slices, 1) + 1).astype(int)
                dense = [_dense(np.floor(1024.0 * part[:, lo:hi])) if slices else ("<f8", part.astype("<f8").tobytes()) for lo, hi in zip(cuts, cuts[1:])]
                row = [key[0], key[1], int(rids[a]), ids[a : a + cap].tobytes(), rids[a : a + cap].tobytes(), [{"kind": kind, "body": body} for kind, body in dense]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("kind", pa.string()), ("body", pa.binary())]))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["dims", "q", "chunk", "ids", "rids", "parts"])

        for batch in batches:
            d, q, ids, rids = (batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "q", "vec_id", "rid"))
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(d)
            begins = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (q[1:] != q[:-1])])
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(d)] if len(d) else []):
                now = (int(d[a]), int(q[a]))
                if held and (now != key or (rows and sum(len(h[0]) for h in held) >= rows)):
                    yield from flush()
                key = now
                held.append((ids[a:b], rids[a:b], flat[ends[a] - d[a] : ends[b - 1]].reshape(b - a, now[0])))
        if held:
            yield from flush()

    return run


def _packed(vectors: DataFrame, rows: int, slices: int) -> DataFrame:
    return vectors.select("dims", "q", "vec_id", "rid", "x").sortWithinPartitions("dims", "q", "rid").mapInArrow(_pack(rows, slices), PACKED)


def _nodes(chunks: DataFrame, of: str = "") -> DataFrame:
    """A row for each slice of each chunk."""
    others = [c for c in chunks.columns if c != f"{of}parts"]
    return chunks.select(*others, F.posexplode(f"{of}parts").alias("slice", "part")).select(*others, "slice", F.col("part.kind").alias(f"{of}kind"), F.col("part.body").alias(f"{of}body"))


def _sides(r: dict) -> tuple[np.ndarray, ...]:
    """Row numbers and parts of the queries, and vec_ids, row numbers and parts of the candidates."""
    qr, cr = np.frombuffer(r["q_rids"], "<i8"), np.frombuffer(r["rids"], "<i8")
    return qr, _opened(r["q_kind"], r["q_body"], len(qr)), np.frombuffer(r["ids"], "<i8"), cr, _opened(r["kind"], r["body"], len(cr))


def _entries(r: dict, qi: np.ndarray, ci: np.ndarray, ids: np.ndarray, local: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(qi), 1 << 16):
        i, j, x = qi[a : a + (1 << 16)], ci[a : a + (1 << 16)], local[a : a + (1 << 16)]
        n = len(i)
        cols = [np.full(n, r["dims"]), np.full(n, r["q"]), i, np.full(n, r["slice"]), np.full(n, r["chunk"]), j, ids[j], x.astype(np.int64)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["dims", "q", "qi", "slice", "chunk", "ci", "vec_id", "local"])


def _gather(k: int):
    """The k best local scores of each query in a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qr, q, ids, cr, c = _sides(r)
                local = q @ c.T
                local[qr[:, None] == cr[None, :]] = -np.inf
                n = min(k, len(ids))
                top = np.argpartition(-local, n - 1, axis=1)[:, :n]
                score = np.take_along_axis(local, top, axis=1)
                i, j = np.nonzero(score > -np.inf)
                yield from _entries(r, i, top[i, j], ids, score[i, j])

    return run


def _collect(slices: int):
    """Local scores that reach the query's share of its cutoff; where they are many, one mark (ci = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qr, q, ids, cr, c = _sides(r)
                share = np.full(len(qr), np.inf)
                for x in r["cutoffs"]:
                    share[x["qi"]] = -(-x["cutoff"] // slices)
                local = q @ c.T
                reach = (local >= share[:, None]) & (qr[:, None] != cr[None, :])
                dense = reach.sum(axis=1) > DENSE
                marks = np.flatnonzero(dense)
                yield from _entries(r, marks, np.full(len(marks), -1), ids, np.zeros(len(marks)))
                i, j = np.nonzero(reach & ~dense[:, None])
                yield from _entries(r, i, j, ids, local[i, j])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local scores of the asked pairs of a query chunk and a node."""
    for batch in batches:
        for r in batch.to_pylist():
            _, q, ids, _, c = _sides(r)
            i, j = (np.array([x[f] for x in r["asked"]], dtype=np.int64) for f in ("qi", "ci"))
            local = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 4096]], c[j[a : a + 4096]]) for a in range(0, len(i), 4096)])
            yield from _entries(r, i, j, ids, local)


def _in_place(k: int):
    """The k best scores of a chunk for the asked queries, all slices added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qr, ids, cr = (np.frombuffer(r[c], "<i8") for c in ("q_rids", "ids", "rids"))
                at = np.array(sorted(r["asked"]), dtype=np.int64)
                score = sum(_opened(*q.values(), len(qr))[at] @ _opened(*c.values(), len(cr)).T for q, c in zip(r["q_parts"], r["parts"]))
                score[qr[at][:, None] == cr[None, :]] = -np.inf
                for i, row in zip(at.tolist(), score):
                    best = np.lexsort((ids, -row))[:k]
                    best = best[row[best] > -np.inf]
                    n = len(best)
                    cols = [[r["dims"]] * n, [r["q"]] * n, [i] * n, [r["chunk"]] * n, best, ids[best], row[best].astype(np.int64)]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*PAIR, "vec_id", "score"])

    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, rids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_rids"], "<i8")
            n = len(ids)
            cols = [pa.array([r["dims"]] * n, pa.int32()), pa.array([r["q"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids), pa.array(rids)]
            yield pa.RecordBatch.from_arrays(cols, names=["dims", "q", "qi", "query_id", "query_rid"])


def _best(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Pass:
    """The three phases for the queries of one pass."""

    def __init__(self, chunks: DataFrame, queries: DataFrame, scratch: Scratch, k: int, slices: int, name: str):
        self.chunks, self.nodes, self.scratch, self.k, self.slices, self.name = chunks, _nodes(chunks), scratch, k, slices, name
        self.whole_queries, self.queries = queries, _nodes(queries, "q_")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with bounded_batches(df.sparkSession, 4):  # a row holds a chunk
            return self.scratch.keep(df, f"{self.name}-{name}")

    def meet(self, queries: DataFrame) -> DataFrame:
        return self.nodes.join(F.broadcast(queries), ["dims", "slice"])  # PASS_BYTES at most

    def resolve(self, known: DataFrame, name: str) -> DataFrame:
        """Entries of some slices -> (PAIR, vec_id, score): the missing parts are fetched, and all added up."""
        every = F.array(*(F.lit(s) for s in range(self.slices)))
        missing = known.groupBy(*PAIR).agg(F.collect_set("slice").alias("seen")).select(*PAIR, F.explode(F.array_except(every, "seen")).alias("slice"))
        asked = missing.groupBy("dims", "slice", "chunk", "q").agg(F.collect_list(F.struct("qi", "ci")).alias("asked"))  # as many as two chunks have pairs
        met = self.nodes.join(asked, ["dims", "slice", "chunk"]).join(F.broadcast(self.queries), ["dims", "slice", "q"])
        fetched = self.keep(met.mapInArrow(_fetch, ENTRY), name)
        both = known.unionByName(fetched)
        return both.groupBy(*PAIR).agg(F.first("vec_id").alias("vec_id"), F.sum("local").alias("score"))

    def run(self) -> DataFrame:
        k, slices = self.k, self.slices
        query = ["dims", "q", "qi"]
        lists = self.keep(self.meet(self.queries).mapInArrow(_gather(k), ENTRY), "lists")
        order = Window.partitionBy(*query, "slice").orderBy(F.desc("local"), "vec_id")
        heads = lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HEADS * k).drop("r")
        heads = self.keep(self.resolve(self.keep(heads, "heads"), "head_parts"), "head_scores")
        cutoffs = self.keep(_best(heads, query, k).groupBy(*query).agg(F.min("score").alias("cutoff")), "cutoffs")
        told = cutoffs.groupBy("dims", "q").agg(F.collect_list(F.struct("qi", "cutoff")).alias("cutoffs"))  # as many as a chunk has queries
        sent = self.keep(self.meet(self.queries.join(told, ["dims", "q"])).mapInArrow(_collect(slices), ENTRY), "entries")
        marks = sent.where("ci < 0").select(*query, "chunk").distinct()
        asked = marks.groupBy("dims", "q", "chunk").agg(F.collect_list("qi").alias("asked"))  # as many as a chunk has queries
        met = self.chunks.join(asked, ["dims", "chunk"]).join(F.broadcast(self.whole_queries), ["dims", "q"])
        dense = self.keep(met.mapInArrow(_in_place(k), "dims int, q long, qi int, chunk long, ci int, vec_id long, score long"), "dense")
        entries = sent.where("ci >= 0").join(marks, [*query, "chunk"], "left_anti")
        sums = entries.groupBy(*PAIR).agg(F.first("vec_id").alias("vec_id"), F.sum("local").alias("score"), F.count("*").alias("seen"))
        sums = self.keep(sums, "sums")
        full = sums.where(F.col("seen") == slices).drop("seen").unionByName(dense)
        better = _best(full.unionByName(heads).distinct(), query, k).groupBy(*query).agg(F.min("score").alias("better"))
        bounds = cutoffs.join(better, query)
        below = F.ceil(F.col("cutoff") / slices) - 1  # what a part that was not sent has at most
        upper = F.col("score") + (slices - F.col("seen")) * below
        left = sums.where(F.col("seen") < slices).join(bounds, query).where(upper >= F.col("better")).select(*PAIR)
        rest = self.resolve(self.keep(entries.join(left, PAIR, "left_semi"), "left"), "parts")
        return self.keep(_best(full.unionByName(rest), query, k).drop("rank"), "best")


def _wide(k: int):
    """Each query's k best of a chunk, in whole numbers of any size, of pairs in which a vector is too large for doubles; beyond: the score is no long."""
    least, most = -(1 << 63), (1 << 63) - 1

    def whole(x: np.ndarray) -> np.ndarray:
        return np.array([[math.floor(y * 1024.0) if abs(y) < 1e300 else int(y) * 1024 for y in v] for v in x.tolist()], dtype=object).reshape(x.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qr, ids, cr = (np.frombuffer(r[x], "<i8") for x in ("q_rids", "ids", "rids"))
                q, c = _opened(*r["q_parts"][0].values(), len(qr)), _opened(*r["parts"][0].values(), len(cr))
                large_q, large_c = (np.abs(x).max(axis=1) >= (_limit(r["dims"]) - 1) / 1024.0 for x in (q, c))
                q, c = whole(q), whole(c)
                out: list[tuple] = []
                for i in range(len(qr)):
                    at = np.flatnonzero((cr != qr[i]) & (large_q[i] | large_c))
                    scores = sorted((-sum(map(int.__mul__, q[i], c[j])), int(ids[j]), j) for j in at.tolist())[:k]
                    out += [(r["dims"], r["q"], i, r["chunk"], j, v, max(least, min(most, -s)), not least <= -s <= most) for s, v, j in scores]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                cols = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=[*PAIR, "vec_id", "score", "beyond"])

    return run


def _limit(dims: int) -> float:
    """Vectors whose scaled components stay below it have inner products that doubles hold exactly."""
    return math.floor(math.sqrt(EXACT / dims))


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, slices: int = SLICES) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query's k best others.

    Components count as floor(1024 * x), x as double. Every row is a vector of its own: a
    repeated vec_id is as many candidates, and as many queries, as it has rows; only a
    query's own row is none of its candidates. Ties go to the smaller vec_id; with fewer
    others, all are given. Vectors that are null or empty, or hold a null or non-finite
    component take no part, nor do null vec_ids. Only vectors of one length are compared.
    A score to be given that is no long ends the job with an error. vec_ids are whole
    numbers; any other type is a TypeError. Other columns are ignored. No queries: no rows.
    """
    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.transform("embedding", lambda y: y.cast("double"))
    good = vectors.where("vec_id is not null").where(usable(F.col("embedding")))
    good = good.select(long_ids(good, "vec_id"), x.alias("x"), F.size("embedding").alias("dims"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    largest = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    good = good.withColumn("wide", largest >= (F.floor(F.sqrt(F.lit(EXACT) / F.col("dims"))) - 1) / 1024.0).withColumn("rid", F.monotonically_increasing_id())
    good = scratch.keep(good, "vectors")
    same = Window.partitionBy("h", "g").orderBy("vec_id", "rid")
    cands = good.withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(1), "x")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    cands = cands.withColumn("q", F.lit(0).cast("long"))
    counts = good.where("is_query").groupBy("dims").agg(F.count("*").alias("n"), F.max("wide").alias("wide")).collect()  # a row for each length of vector
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = good.where("wide").select("dims").distinct()
    per = {r["dims"]: min(QUERIES, max(1, PASS_BYTES // (32 * r["dims"]))) for r in counts}  # a chunk is a quarter of a pass at most
    sizes = [(r["dims"], math.ceil(r["n"] / per[r["dims"]]), max(1, PASS_BYTES // (8 * per[r["dims"]] * r["dims"]))) for r in counts]
    passes = max(math.ceil(chunks / each) for _, chunks, each in sizes)
    dealt = good.where("is_query").join(F.broadcast(spark.createDataFrame(sizes, "dims int, chunks long, each long")), "dims").withColumn("q", F.pmod(F.xxhash64("rid"), "chunks"))
    dealt = dealt.repartition("dims", "q")
    named = lambda df: df.select("dims", "q", F.col("ids").alias("q_ids"), F.col("rids").alias("q_rids"), F.col("parts").alias("q_parts"))
    queries = scratch.keep(named(_packed(dealt.where("not wide"), 0, slices)), "queries")
    chunks = scratch.keep(_packed(cands.where("not wide"), CHUNK, slices).drop("q").repartition(spread), "chunks")
    turn = lambda df, p: df.join(F.broadcast(spark.createDataFrame([(d, e) for d, _, e in sizes], "dims int, each long")), "dims").where(F.floor(F.col("q") / F.col("each")) == p).drop("each")
    found, names = [], [queries]
    for p in range(passes):
        found.append(_Pass(chunks, turn(queries, p), scratch, k, slices, f"pass{p}").run().withColumn("beyond", F.lit(False)).withColumn("of", F.lit(0)))
    if not wide.isEmpty():
        whole = scratch.keep(named(_packed(dealt.join(wide, "dims", "left_semi"), 0, 0)), "whole_queries")
        all_chunks = scratch.keep(_packed(cands.join(wide, "dims", "left_semi"), CHUNK, 0).drop("q").repartition(spread), "whole_chunks")
        names.append(whole)
        for p in range(passes):
            met = all_chunks.join(F.broadcast(turn(whole, p)), "dims")
            with bounded_batches(spark, 4):
                found.append(scratch.keep(met.mapInArrow(_wide(k), "dims int, q long, qi int, chunk long, ci int, vec_id long, score long, beyond boolean"), f"wide{p}").withColumn("of", F.lit(1)))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    told = None
    for of, df in enumerate(names):
        one = df.select("dims", "q", "q_ids", "q_rids").mapInArrow(_names, "dims int, q long, qi int, query_id long, query_rid long").withColumn("of", F.lit(of))
        told = one if told is None else told.unionByName(one)
    rows = _best(rows.join(told, ["of", "dims", "q", "qi"]), ["query_rid"], k)
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score is no long")).cast("long")).otherwise(F.col("score"))
    return rows.select("query_id", "rank", "vec_id", score.alias("score"))
