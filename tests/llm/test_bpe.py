"""Encoding equals the tokenizers library id for id; decoding is its decode."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shardlens.llm import bpe
from shardlens.llm.common import tokenizer_path

PATH = tokenizer_path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.load(PATH).encode(text)
    assert own.tolist() == ids
    assert bpe.load(PATH).decode(own) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    same(library, text)


def test_words_of_the_vocabulary_side_by_side(library):
    words, rnd = sorted(library.get_vocab()), random.Random(3)
    for _ in range(2000):
        same(library, "".join(rnd.choice(words).replace("</w>", "") for _ in range(rnd.randint(1, 5))))


@pytest.mark.parametrize("text", ["", " ", "\x1ca\x1f b", "x <|endoftext|>y<|startoftext|> <|end", "we'll don't 'S",
                                  "ΑΣ İ é  x y", "a" * 5000, "!?" * 3000, "﻿x​y"])
def test_edges(library, text):
    same(library, text)


def test_columns(spark, library):
    texts = [None, "", "The the THE", "long " * 20000]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = rows.select("doc_id", "ids", bpe.encode(F.col("text"), PATH).alias("n")).withColumn("back", bpe.decode(F.col("n"), PATH))
    for r in out.collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n == want and r.ids == "kept" and r.back == library.decode(want, skip_special_tokens=False)
    bad = spark.createDataFrame([([-1, 320, None, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in bad.select(bpe.decode(F.col("ids"), PATH)).collect()] == ["a</w>", None, ""]


def test_whole_table(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op3_backtracking_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
