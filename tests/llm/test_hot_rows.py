"""Rows that are equal in all columns, rows of null ids, and benchmark windows that very many items share."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from cairnfield.llm import decontaminate, exchange, mixture, perplexity, substrings  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def test_equal_rows_are_no_chunk_of_their_own(spark):
    df = spark.createDataFrame([(None, "same words here", "a")] * 4000 + [(i, f"w{i} x", "a") for i in range(100)], SCHEMA).repartition(16)
    dealt, chunks = exchange.chunked(df, ["doc_id", "text"], 1000, classes=8)
    rows = dealt.groupBy("text", (F.col("chunk") % 8).alias("c")).agg(F.countDistinct("chunk").alias("chunks"), F.count("*").alias("n")).filter("text like 'same%'").collect()
    assert chunks % 8 == 0 and dealt.count() == 4100 and dealt.agg(F.max("chunk")).first()[0] < chunks
    assert len(rows) == 1 and rows[0]["n"] == 4000 and rows[0]["chunks"] > 3  # of one class, in many chunks


def test_results_over_equal_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long)] * 30 + [(None, "")] * 30 + [(i, f"w{i} {long} z{i}" if i % 3 else f"only {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted((tuple(r) for r in substrings.scan(df, chunk_bytes=500).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == sorted(brute.substrings(rows), key=repr)
    few, many = (sorted((tuple(r) for r in perplexity.scan(df.repartition(n), chunk_bytes=400).select("doc_id", "n_tokens", "n_known", F.round("score", 6)).collect()), key=repr) for n in (1, 8))
    assert few == many  # the model does not depend on how the table is cut


@pytest.mark.parametrize("partitions", [1, 7])
def test_mix_of_null_ids(spark, partitions):
    rows = [(None, f"a{i} b c", "a") for i in range(5000)] + [(None, "", "a")] * 3000 + [(None, "same same", "b")] * 3000 + [(i, "x " * 7, "c") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    out = mixture.mix(df, ["text"]).cache()
    assert out.count() == len(rows)
    totals = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 7 and r["over"] <= 0 for r in totals)
    assert out.filter("size = 0").agg(F.sum("taken")).first()[0] == 0
    again = mixture.mix(df.repartition(3), ["text"])
    assert out.select("text", "taken").exceptAll(again.select("text", "taken")).isEmpty()


@pytest.mark.parametrize("most", [64 << 20, 10])
def test_windows_that_many_items_share(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
    shared = " ".join(f"t{i}" for i in range(12))
    bench = spark.createDataFrame([(str(i), f"{shared} own{i} x{i}") for i in range(400)], "item_id string, text string")
    df = spark.createDataFrame([(i, f"before {shared} after{i}") for i in range(50)] + [(99, f"{shared} own7 x7"), (100, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.scan(df, bench).collect()}
    assert got == {i: (12, 400) for i in range(50)} | {99: (14, 400), 100: (0, 0)}
