"""What the queries of operators without SQL return, over whole tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import queries
from tidewater.llm.vocabulary import VOCABULARY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall())


@pytest.mark.parametrize("name, folds, held", [("op3_toxicity", 5, 0), ("op5_quality_classifier", 3, 1)])
def test_scores(spark, texts, name, folds, held):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_token_queries(spark, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    start, files, digests = 0, [], []
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids
        files.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        start += len(ids) + 1
        said = tokenizer.decode(ids, skip_special_tokens=False)
        digests.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op8_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == files
    assert sorted(map(tuple, queries.op9_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == digests
