"""A word's hash does not depend on the words around it."""

import pyarrow as pa

from cairnfield.llm import vec


def test_hash_of_a_word_alone_and_among_longer_ones():
    words = ["a", "eightbyt", "ninebytes", "x" * 17, "y" * 24, "z" * 40, "q" * 256, "r" * 300]
    every = vec.Words(pa.array([" ".join(words)], pa.large_string())).hash
    assert [vec.Words(pa.array([w], pa.large_string())).hash[0] for w in words] == list(every) and len(set(every.tolist())) == len(words)
