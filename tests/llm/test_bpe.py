"""BPE against the tokenizers library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(7)
    kinds = ["abcdefgh  e", "aaaab ", "ABCxyz'stll ", "\t\n\r \x0b\x0c\x1c\x1f\x85\xa0 　 a", "éüßçñ àô", "日本語한국", "\U0001f600\U0001f1e6́ ", "0123456789.,-_:;!?()[]{}<|>#", "½²Ⅷ٣ x", "﻿​­\x00\x7f"]
    made = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    return ["", " ", "\n\n  x", "I'll we've it's DON'T", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "x" * 5000, "the cat " * 3000, "=" * 301, *made]


def test_encode_matches_library(library):
    own, given = bpe.Bpe(PATH), texts()
    ids, count = own.encode(given)
    expected = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    ends = np.cumsum(count)
    for t, a, b, want in zip(given, ends - count, ends, expected, strict=True):
        assert ids[a:b].tolist() == want, t
    assert own.decode(ids.astype(np.int64), count) == [library.decode(x, skip_special_tokens=False) for x in expected] == given


def test_decode_of_any_ids(library):
    rng, own = random.Random(3), bpe.Bpe(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, np.int64), np.array([len(ids)])) == [library.decode(ids, skip_special_tokens=False)]


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, "é" * 70000, "y")], "doc_id long, text string, token_ids string")
    got = bpe.encode_documents(df, PATH).withColumn("back", bpe.decode(F.col("token_ids"), PATH)).collect()
    assert sorted((r.n_tokens, len(r.back)) for r in got)[:2] == [(0, 0), (0, 0)] and max(len(r.back) for r in got) == 70000
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
