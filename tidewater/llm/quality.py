"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is described by the shares of
its kinds of letters, by its words' lengths and by how much of it repeats (within itself
and elsewhere in its document). An encoder maps it to h = tanh(E x); gated attention gives
it the weight a = softmax(w . (tanh(V h) * sigmoid(U h))); the document's score is the
logistic function of the weighted sum of its h. Encoder, attention and classifier are
learned together from the documents' labels by Adam.
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

PASSAGE = 64
HIDDEN = 16
U64 = np.uint64

#: The kind of each byte: kinds from 0 on, in this order, then other controls.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "%", "$", "&", "*", "#", "@", "/\\", ":;", "-_", "'\"`", "()[]{}", "<>", "=+~^"]
KIND = np.full(256, len(_GROUPS) + 1, dtype=np.uint8)
for _k, _group in enumerate(_GROUPS):
    KIND[np.frombuffer(_group.encode(), dtype=np.uint8)] = _k
KIND[128:] = len(_GROUPS)
KINDS = len(_GROUPS) + 2
WIDTH = KINDS + 6


def passages(words: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x WIDTH) and where each text's passages begin; a text without words has one passage of zeros."""
    count = np.diff(words.first)
    per = np.maximum(1, -(-count // PASSAGE))
    first = np.r_[0, np.cumsum(per)]
    x = np.zeros((first[-1], WIDTH))
    if not len(words.start):
        return x, first
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - words.first[owner]
    passage = first[owner] + place // PASSAGE
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    at = passage[heads]
    size = np.diff(np.r_[heads, len(passage)])
    byte_ends = np.r_[words.start[heads[1:]], len(words.data)]
    last = np.r_[owner[heads[1:]] != owner[heads[:-1]], True]
    byte_ends[last] = words.offsets[owner[heads[last]] + 1]
    spot = np.repeat(at, byte_ends - words.start[heads])
    begins = np.repeat(words.start[heads] - np.r_[0, np.cumsum(byte_ends - words.start[heads])[:-1]], byte_ends - words.start[heads])
    kinds = KIND[words.data[begins + np.arange(len(begins))]]
    hist = np.bincount(spot * KINDS + kinds, minlength=len(x) * KINDS).reshape(-1, KINDS)
    x[:, :KINDS] = hist / np.maximum(1, hist.sum(axis=1, keepdims=True))
    length = (words.end - words.start).astype(float)
    x[at, KINDS] = np.add.reduceat(length, heads) / size / 10
    x[at, KINDS + 1] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, heads) / size - (x[at, KINDS] * 10) ** 2)) / 10
    x[at, KINDS + 2] = np.log1p(size) / 5
    hashes = words.hashes()
    x[at, KINDS + 3] = _repeats(hashes, passage, len(x))[at] / size
    runs = hashes.copy()
    runs[:-1] += hashes[1:] * U64(3)
    runs[:-2] += hashes[2:] * U64(5)
    x[at, KINDS + 4] = _share(runs, owner, passage, len(x))[at] / size
    x[at, KINDS + 5] = np.log1p(count[owner[heads]]) / 10
    return x, first


def _repeats(values: np.ndarray, within: np.ndarray, n: int) -> np.ndarray:
    """How many values of each passage have come before in it."""
    key = B.mix(values + within.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(within[again], minlength=n)


def _share(values: np.ndarray, owner: np.ndarray, within: np.ndarray, n: int) -> np.ndarray:
    """How many values of each passage occur more than once in its text."""
    key = B.mix(values + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.bincount(within[again], minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    parts: dict[str, np.ndarray]

    def attend(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Score of each bag, weight of each passage, and what backward steps need."""
        p = self.parts
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        logit = (v * u) @ p["w"]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        logit -= np.maximum.reduceat(logit, first[:-1])[owner] if len(logit) else 0
        a = np.exp(logit)
        a /= (np.add.reduceat(a, first[:-1]) if len(a) else a)[owner]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0) if len(a) else np.zeros((0, HIDDEN))
        return sigmoid(z @ p["c"] + p["b"]), a, {"x": x, "h": h, "v": v, "u": u, "owner": owner, "z": z}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        score, a, k = self.attend(x, first)
        d = (score - y) * weight / weight.sum()
        own = k["owner"]
        dz = d[:, None] * p["c"]
        da = (dz[own] * k["h"]).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, first[:-1])[own])
        dvu = dl[:, None] * p["w"]
        dv = dvu * k["u"] * (1 - k["v"] ** 2)
        du = dvu * k["v"] * k["u"] * (1 - k["u"])
        dh = a[:, None] * dz[own] + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - k["h"] ** 2)
        return {
            "E": k["x"].T @ de, "e": de.sum(axis=0), "V": k["h"].T @ dv, "U": k["h"].T @ du,
            "w": ((k["v"] * k["u"]) * dl[:, None]).sum(axis=0), "c": k["z"].T @ d, "b": np.array([d.sum()]),
        }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02, ridge: float = 1e-4) -> Model:
    """Both classes weigh the same; the start is fixed, so equal samples give equal models. Without a sample every score is 0.5, which keeps."""
    rng = np.random.default_rng(5)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    parts = {"E": draw(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, HIDDEN), "U": draw(HIDDEN, HIDDEN), "w": draw(HIDDEN), "c": draw(HIDDEN), "b": np.zeros(1)}
    if not len(y):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), parts | {"c": np.zeros(HIDDEN)})
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, parts)
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    m = {k: np.zeros_like(v) for k, v in parts.items()}
    s = {k: np.zeros_like(v) for k, v in parts.items()}
    for step in range(1, rounds + 1):
        for k, g in model.gradient(x, first, y, weight).items():
            g = g + ridge * parts[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            parts[k] = parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in B.runs(batch.column("text"), B.NOT_SPACE):
            x, first = passages(words)
            bags = pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), bags], names=["label", "bag"])


def train(docs: DataFrame, labels: DataFrame, may_use: Column, most: tuple[int, int] = (1_000, 1_000)) -> Model:
    """Fits on so many bad and good labelled documents at most (`labelled.sample`); their passages' features are what is gathered."""
    bounded_batches(docs.sparkSession)
    rows = sample(docs, labels, "quality", may_use, most).mapInArrow(_extract, "label int, bag binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"]).reshape(-1, WIDTH) for r in rows]
    return fit(np.concatenate([np.zeros((0, WIDTH)), *bags]), np.cumsum([0, *map(len, bags)]), np.array([r["label"] for r in rows], dtype=float))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in B.runs(batch.column("text"), B.NOT_SPACE):
                x, first = passages(words)
                score, attention, _ = model.attend(x, first)
                top = np.maximum.reduceat(attention, first[:-1])
                cols = [batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array(np.diff(first), pa.int32()), pa.array(top)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "n_passages", "top_attention"])

    return run


def keeper(model: Model):
    """Rows (text and any other columns) whose document is held for good; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in B.runs(batch.column("text"), B.NOT_SPACE):
                x, first = passages(words)
                yield batch.slice(a, b - a).filter(pa.array(model.attend(x, first)[0] >= 0.5))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score, n_passages, top_attention), one row per document.

    score: 0 to 1, higher: good quality likelier; top_attention: the largest weight of a
    passage. Null, empty and blank texts count as one passage without any letters. Repeated
    and null doc_ids are kept; other columns are ignored. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double, n_passages int, top_attention double")
