"""Toxicity: a linear-chain conditional random field over the words of each sentence.

Labels come by document; its tokens are labelled first. A word, or a start of it, that
occurs in toxic documents far beyond their share (likelihood ratio over different places)
marks its tokens there; all other tokens are clean. On these tokens the chain is trained: hashed
features of the word, its starts and its end, and one weight for each pair of neighbouring
tags. With two tags the forward and backward recursions run on log-odds, for all sentences
of a portion side by side. A document's score is a logistic function of its largest
marginal and of the expected number of toxic tokens; runs of tokens with a marginal of a
half or more are its offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytestext as B
from tidewater.llm.labelled import sample
from tidewater.session import bounded_batches

U64 = np.uint64
SPACE_BITS = 18
STARTS = (4, 5, 6)
KINDS = len(STARTS) + 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[10, 13, 33, 46, 63]] = True


def features(words: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (tokens x KINDS) and whether each token begins a sentence."""
    words.data = LOWER[words.data]
    s, e = words.start, words.end
    spans = [(s, e), *((s, np.minimum(s + k, e)) for k in STARTS), (np.maximum(s, e - 3), e)]
    out = np.empty((len(s), KINDS), dtype=np.uint32)
    for k, (a, b) in enumerate(spans):
        out[:, k] = B.mix(words.span_hash(a, b) + U64(k)) >> U64(64 - SPACE_BITS)
    breaks = np.cumsum(BREAKS[words.data])
    begins = np.ones(len(s), dtype=bool)
    if len(s) > 1:
        begins[1:] = breaks[s[1:]] != breaks[s[:-1]]
    begins[words.first[:-1][np.diff(words.first) > 0]] = True
    return out, begins


def _flow(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds after a step: t is [[t00, t01], [t10, t11]], from row to column."""
    return np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)


def forward_backward(emit: np.ndarray, begins: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the tag from the left (with the token's own) and from the right (without)."""
    left, right = emit.copy(), np.zeros(len(emit))
    start = np.flatnonzero(begins)
    size = np.diff(np.r_[start, len(emit)])
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # sentences of more than t tokens
    for k in range(1, longest):
        at = start[: live[k]] + k
        left[at] += _flow(left[at - 1], t)
    for k in range(longest - 1, 0, -1):
        at = start[: live[k]] + k
        right[at - 1] = _flow(emit[at] + right[at], t.T)
    return left, right


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    tags: np.ndarray
    scale: np.ndarray  # of the document's score: constant, largest marginal's log-odds, log of the expected count

    def marginals(self, feats: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-odds of each token's toxic tag."""
        emit = self.weights[feats].sum(axis=1, dtype=np.float64) + self.bias
        left, right = forward_backward(emit, begins, self.tags)
        return left + right

    def documents(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(_summary(odds, first) @ self.scale)


def _summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, 3))
    out[:, 0], out[:, 1] = 1, -12
    has = np.diff(first) > 0
    if has.any():
        begins = first[:-1][has]
        out[has, 1] = np.clip(np.maximum.reduceat(odds, begins), -12, 12)
        out[has, 2] = np.log1p(np.add.reduceat(sigmoid(odds), begins))
    return out


def token_labels(feats: np.ndarray, first: np.ndarray, toxic: np.ndarray, least: float = 24.0) -> np.ndarray:
    """Tags of the training tokens from the documents' labels.

    Counts are of different places: a feature between the same two words counts once, so
    copies of a document do not make its words look telling.
    """
    n = 1 << SPACE_BITS
    hot = np.repeat(toxic, np.diff(first))
    word = feats[:, 0].astype(U64) + U64(1)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = first[(first > 0) & (first < len(word))]
    before[inner], after[inner - 1] = 0, 0
    place = B.mix(before * U64(0x9E3779B97F4A7C15) + after) >> U64(SPACE_BITS)
    tags = np.zeros(len(feats), dtype=bool)
    for k in range(KINDS - 1):  # not the ends of words: they are inflections
        key = feats[:, k].astype(U64) << U64(64 - SPACE_BITS) | place
        t, c = (np.bincount((np.unique(key[side]) >> U64(64 - SPACE_BITS)).astype(np.int64), minlength=n).astype(float) for side in (hot, ~hot))
        share = max(t.sum() / max(1.0, t.sum() + c.sum()), 1e-6)
        both = np.maximum(t + c, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(t > 0, t * np.log(t / both / share), 0) + np.where(c > 0, c * np.log(c / both / max(1 - share, 1e-6)), 0))
        tags |= ((ratio >= least) & (t * (1 - share) > 20 * c * share))[feats[:, k]]
    return tags & hot


def fit(feats: np.ndarray, begins: np.ndarray, first: np.ndarray, toxic: np.ndarray, rounds: int = 30, rate: float = 0.25, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample; then the document's logistic function."""
    n = 1 << SPACE_BITS
    y = token_labels(feats, first, toxic).astype(float)
    theta = np.zeros(n + 5)
    theta[n] = -4.0
    m, v = np.zeros(n + 5), np.zeros(n + 5)
    inner = ~begins
    prev = np.flatnonzero(inner) - 1
    here = prev + 1
    true = np.array([((1 - y[prev]) * (1 - y[here])).sum(), ((1 - y[prev]) * y[here]).sum(), (y[prev] * (1 - y[here])).sum(), (y[prev] * y[here]).sum()])
    for step in range(1, rounds + 1):
        tags = theta[n + 1 :].reshape(2, 2)
        emit = sum(theta[feats[:, k]] for k in range(KINDS)) + theta[n]
        left, right = forward_backward(emit, begins, tags)
        gap = sigmoid(left + right) - y
        grad = np.empty(n + 5)
        grad[:n] = sum(np.bincount(feats[:, k], weights=gap, minlength=n) for k in range(KINDS))
        grad[n] = gap.sum()
        a, b = left[prev], emit[here] + right[here]
        joint = np.stack([tags[0, 0] + np.zeros(len(a)), tags[0, 1] + b, tags[1, 0] + a, tags[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0))
        grad[n + 1 :] = (joint / joint.sum(axis=0)).sum(axis=1) - true
        grad[n + 1] = 0
        grad[:n] += ridge * theta[:n]
        grad /= max(1.0, y.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model = Model(theta[:n].astype(np.float32), float(theta[n]), theta[n + 1 :].reshape(2, 2), np.zeros(3))
    x = _summary(model.marginals(feats, begins), first)
    model.scale = calibrate(x, toxic)
    return model


def calibrate(x: np.ndarray, toxic: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights of the documents' summaries, signs of toxicity never below zero."""
    scale = np.array([-3.0, 0.1, 2.0])
    weight = 1 / max(1, len(toxic))
    m, v = np.zeros(3), np.zeros(3)
    for step in range(1, rounds + 1):
        grad = x.T @ ((sigmoid(x @ scale) - toxic) * weight) + 1e-3 * scale
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        scale = scale - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        scale[1:] = np.maximum(scale[1:], 0)
    return scale


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in B.runs(batch.column("text"), B.WORD_BYTES):
            feats, begins = features(words)
            cut = [(feats[i:j].tobytes(), begins[i:j].tobytes()) for i, j in zip(words.first[:-1], words.first[1:])]
            cols = [batch.column("label").slice(a, b - a), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "feats", "begins"])


def train(docs: DataFrame, labels: DataFrame, may_use: Column, most: tuple[int, int] = (2_100, 700)) -> Model:
    """Fits on so many clean and toxic labelled documents at most (`labelled.sample`); their features are what is gathered."""
    bounded_batches(docs.sparkSession)
    rows = sample(docs, labels, "toxic", may_use, most).mapInArrow(_extract, "label int, feats binary, begins binary").collect()
    rows = sorted({(r["label"], bytes(r["feats"]), bytes(r["begins"])) for r in rows})  # copies count once
    rows = [dict(zip(("label", "feats", "begins"), r)) for r in rows]
    feats = np.concatenate([np.zeros((0, KINDS), np.uint32), *(np.frombuffer(r["feats"], np.uint32).reshape(-1, KINDS) for r in rows)])
    begins = np.concatenate([np.zeros(0, bool), *(np.frombuffer(r["begins"], bool) for r in rows)])
    first = np.cumsum([0, *(len(r["begins"]) for r in rows)])
    toxic = np.array([r["label"] == 1 for r in rows], dtype=bool)
    del rows
    return fit(feats, begins, first, toxic)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in B.runs(batch.column("text"), B.WORD_BYTES):
                feats, begins = features(words)
                odds = model.marginals(feats, begins)
                score = model.documents(odds, words.first)
                bad = odds >= 0
                letters = np.cumsum((words.data & 0xC0) != 0x80)  # characters up to and with each byte
                fresh = bad.copy()
                fresh[1:] &= ~bad[:-1] | begins[1:]
                opens = np.flatnonzero(fresh)
                ends = bad.copy()
                ends[:-1] &= ~bad[1:] | begins[1:]
                closes = np.flatnonzero(ends)
                per = np.searchsorted(opens, words.first)
                before = np.r_[0, letters][words.offsets[:-1]]
                shift = np.repeat(before, np.diff(per))
                begin = letters[words.start[opens]] - 1 - shift if len(opens) else np.zeros(0, int)
                end = letters[words.end[closes] - 1] - shift if len(opens) else np.zeros(0, int)
                pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["begin", "end"])
                spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), spans], names=["doc_id", "score", "spans"])

    return run


def keeper(model: Model):
    """Rows (text and any other columns) whose document is held for clean; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in B.runs(batch.column("text"), B.WORD_BYTES):
                feats, begins = features(words)
                yield batch.slice(a, b - a).filter(pa.array(model.documents(model.marginals(feats, begins), words.first) < 0.5))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score, spans), one row per document.

    score: 0 to 1, higher: toxic likelier. spans: begin and end, in characters of the text,
    of the runs of tokens tagged toxic. Null and empty texts have the score of a text
    without any sign and no spans. Repeated and null doc_ids are kept; other columns are
    ignored. Without labelled documents of both classes all scores say little but are
    defined. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double, spans array<struct<begin:int,end:int>>")
