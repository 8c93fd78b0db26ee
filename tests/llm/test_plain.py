"""What needs no Spark: coding, hashing, models, tables."""

import gc
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewater.llm import bpe, bytestext, decontaminate, license_scan, near_duplicates, quality, rans, sharding, token_files, toxicity
from tidewater.llm.bpe import TrieEncoder
from tidewater.llm.chunked import ChunkCache
from tidewater.llm.vocabulary import VOCABULARY
from tidewater.llm.word_trie import WordTrie


def test_trie_bpe_equals_the_library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    cache = ChunkCache(TrieEncoder(WordTrie(VOCABULARY)), most=500)
    letters = " \n\t\x1c\x85\xa0  '’sStTdmlrve<|endoftext|>ABΣσςİıßéÉé字١12½_-!?.,​﻿😀\x00"
    random.seed(1)
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["it's we've <|endoftext|> x<|startoftext|>y", "", "   ", None, "a" * 5000, "internationalization " * 50]
    for lo in range(0, len(texts), 300):
        part = texts[lo : lo + 300]
        for text, raw in zip(part, cache.encode(part)):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 33, 4097, 70_000])
def test_rans_round_trip_and_checksums(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 49_000)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=49_408)))
    block = rans.encode_block(ids, table, lanes=64, every=16)
    assert (rans.decode_block(block, table) == ids).all()
    if n > 100:
        bad = bytearray(block)
        bad[-3] ^= 4
        with pytest.raises(ValueError):
            rans.decode_block(bytes(bad), table)
        with pytest.raises(ValueError):
            rans.decode_block(block[:-4], table)


def test_scaled_tables_are_whole():
    for counts in ([1], [5, 0, 1], np.arange(40_000), [10**12, 1, 1]):
        parts = rans.scaled(np.array(counts))
        assert parts.sum() == 1 << rans.SCALE
        assert ((parts > 0) == (np.array(counts) > 0)).all()
    assert rans.scaled(np.zeros(3)).sum() == 0


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e f", "x a b c d e", "a b", "", None, "a  b\tc d\ne f"]
    ((_, _, words),) = bytestext.runs(pa.array(texts), bytestext.NOT_SPACE)
    values, first = bytestext.shingle_hashes(words)
    assert np.diff(first).tolist() == [2, 2, 1, 0, 0, 2]
    assert values[0] == values[3] and (values[:2] == values[-2:]).all()
    assert len(set(values[:5].tolist())) == 4


def test_bands_and_radius_are_safe():
    bands, rows = near_duplicates.plan_bands(0.8, 1e-7)
    assert (1 - 0.8**rows) ** bands <= 1e-7
    radius = decontaminate.plan_radius(0.8, 1e-4)
    masks = decontaminate.block_masks(radius)
    assert len(masks) == radius + 1 and sum(masks) == (1 << 64) - 1


def test_overlaps_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype("<u8")) for _ in range(40)]
    got = near_duplicates._overlaps(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_maglev_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.build_table(names, 1009)
    sizes = [table.count(n) for n in names]
    assert max(sizes) - min(sizes) <= 1
    less = sharding.build_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != "s9")
    assert moved < 1009 * 0.1
    with pytest.raises(ValueError):
        sharding.build_table(names, 1000)


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, tags = rng.normal(size=6), rng.normal(size=(2, 2))
    begins = np.array([1, 0, 0, 1, 0, 0], bool)
    left, right = toxicity.forward_backward(emit, begins, tags)
    for lo in (0, 3):
        total, hot = 0.0, np.zeros(3)
        for y in np.ndindex(2, 2, 2):
            s = np.exp(sum(emit[lo + k] * y[k] for k in range(3)) + tags[y[0], y[1]] + tags[y[1], y[2]])
            total += s
            hot += s * np.array(y)
        assert np.allclose(toxicity.sigmoid((left + right)[lo : lo + 3]), hot / total)


def test_attention_gradient_is_right():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, first, y, rounds=3)
    weight = np.ones(3)
    grad = model.gradient(x, first, y, weight)

    def loss():
        p = model.attend(x, first)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, v in model.parts.items():
        at = tuple(0 for _ in v.shape)
        keep = v[at]
        v[at] = keep + 1e-5
        up = loss()
        v[at] = keep - 1e-5
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6, k


def test_anchors_lose_no_line():
    templates = [("A", "alpha the licence", ()), ("B", "the beta", ())]
    idf = {"alpha": 3.0, "the": 1.0, "licence": 2.0, "beta": 2.5}
    assert license_scan.anchors(templates, idf, 0.7) >= {"alpha", "beta"}


def test_token_ids_of_plain_and_other_chunks_equal_the_library():
    plain = Tokenizer.from_file(VOCABULARY)
    draw = random.Random(8)
    letters = "abzßöøÿ÷×éÉÀ.,!?'<|>_-*$ \t\n0٣̧́Σσςıİﬁ\x01"
    texts = ["", None, "ab <|endoftext|> cd.", "it's, don't 'S x'll", "é.,, ß** a÷ µ º", *("".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(2000))]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_files._library(VOCABULARY, "<u2").encode(texts) == want


def test_a_chunk_is_looked_up_once_however_often_it_occurs():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    cache = ChunkCache(lambda chunks: ([len(c) for c in chunks], [1] * len(chunks)))
    cache.known = Counted(cache.known)
    texts = ["bb a ccc\n" * 100, "A\tbb"] * 20
    want = [np.array([n for _ in range(100) for n in (2, 1, 3)], dtype="<u4").tobytes(), np.array([1, 2], dtype="<u4").tobytes()] * 20
    assert cache.encode(texts) == want
    assert cache.encode(texts) == want and Counted.asked <= 16


def test_what_a_task_holds_of_long_batches_is_small():
    texts = [("der Hase läuft. " * 2000)[: 30_000 + k] for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    rng = np.random.default_rng(1)
    good = quality.fit(rng.normal(size=(40, quality.WIDTH)), np.arange(0, 41, 2), (np.arange(20) % 2).astype(float), rounds=2)
    tags = toxicity.Model(np.zeros(1 << toxicity.SPACE_BITS, np.float32), -1.0, np.zeros((2, 2)), np.array([-3.0, 0.1, 2.0]))
    for keep in (quality.keeper(good), toxicity.keeper(tags)):
        list(keep(iter([batch.slice(0, 1)])))
        tracemalloc.start()
        rows = sum(len(b) for b in keep(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows <= 60 and peak < 30e6


def test_words_of_a_task_are_let_go_at_its_end(monkeypatch):
    made = []

    class Seen(ChunkCache):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(weakref.ref(self))

    monkeypatch.setattr(bpe, "ChunkCache", Seen)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["ab cd", None])], names=["doc_id", "text"])
    for _ in range(2):
        assert sum(len(b) for b in bpe._encode(VOCABULARY)(iter([batch]))) == 2
    gc.collect()
    assert len(made) == 2 and all(m() is None for m in made)
