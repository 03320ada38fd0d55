"""Operator 13 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(byte_bpe.default_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.query(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {k: expected(library, t) for k, t in docs.items()}


def test_pieces(library):
    own = byte_bpe.Tokenizer(open(byte_bpe.default_path(), encoding="utf-8").read())
    rnd = random.Random(5)
    letters = "ab' stredlvm\t\n\r0123  　éß字🙂.,<|>\x1c\x1f\x85ıſ"
    texts = ["".join(rnd.choice(letters) if rnd.random() < 0.96 else "<|endoftext|>" for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>", "I'm you're we'll it's", "a" * 50_000, " " * 70_000 + "x", "ab" * 30_000, "x y " * 400_000, "\x00\x7f﻿‍퟿￿\U0010ffff"]
    for text in texts:
        packed = own.encode(text)
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == text


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    own = byte_bpe.Tokenizer(open(byte_bpe.default_path(), encoding="utf-8").read())
    text = " ".join(f"word{k % 7} and{k % 5}" for k in range(200))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "Hello wörld", 3), (2, "Hello wörld", 3), (3, "a" * 300_000, 4)], "doc_id long, text string, ids int")
    tokens = byte_bpe.encode(docs)
    assert tokens.columns == ["doc_id", "ids"]
    both = byte_bpe.decode(tokens, keep=("doc_id", "ids")).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]) > 0, r["text"]) for r in both) == sorted((r["doc_id"] or 0, bool(r["text"]), r["text"] or "") for r in docs.collect())
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    numbers = tokens.select("doc_id", byte_bpe.unpacked().alias("ids"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in byte_bpe.decode(numbers).collect()) == sorted((r["doc_id"] or 0, r["text"]) for r in both)
    assert numbers.filter("doc_id = 1").select(F.size("ids")).first()[0] == 0


def test_bytes_that_are_no_text(spark, library):
    ids = [[250, 98, 99999999], [160, 160], None, []]
    got = byte_bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id int, ids array<long>"))
    known = lambda x: [i for i in x or [] if i < 50257]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {k: library.decode(known(x), skip_special_tokens=False) for k, x in enumerate(ids)}
