"""Scores do not depend on what lies around a document, as keys of n-grams are whole."""

import numpy as np

from cairnfield.llm import exchange, perplexity


def test_keys_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 5000):
        for most in (2, 300, 1 << 20, 1 << 63):
            keys = np.unique(rng.integers(0, most, n, dtype=np.uint64))
            assert (exchange.unpack_keys(exchange.pack_keys(keys)) == keys).all() and len(exchange.unpack_keys(exchange.pack_keys(keys))) == len(keys)
    far = np.array([0, 1, 2, 3, 2**64 - 1], np.uint64)
    assert (exchange.unpack_keys(exchange.pack_keys(far)) == far).all()


def test_counts_are_exact_whatever_the_size(spark):
    """The same training counts give the same scores beside held-out documents of any size: these train nothing."""
    rows = [(k, f"the cat number {k % 7} sat on the mat and the dog {k % 5} did not") for k in range(60)]
    held = next(k for k in range(1000, 5000) if spark.range(k, k + 1).select(perplexity.rows.held_out("id", *perplexity.HELD_OUT)).first()[0])
    few = spark.createDataFrame([*rows, (held, "cat")], "doc_id long, text string")
    many = spark.createDataFrame([*rows, (held, " ".join(f"x{i}" for i in range(60_000)))], "doc_id long, text string")
    keyed = lambda df: {r["doc_id"]: r for r in perplexity.scan(df).collect() if r["doc_id"] != held}
    a, b = keyed(few), keyed(many)
    assert all(abs(a[k]["base_score"] - b[k]["base_score"]) < 1e-9 and abs(a[k]["score"] - b[k]["score"]) < 1e-9 for k in a)
