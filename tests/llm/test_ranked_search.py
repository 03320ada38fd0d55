"""Operator 12 against a plain version; its query is compared with SQL in test_llm_queries."""

import math
import random
import re
from collections import Counter, defaultdict

from cairnfield.llm import ranked_search


def plain(docs, items, k=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, some in asked.items():
        scores = []
        for doc, c in counts:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in some if c[t])
                if score > 0:
                    scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items):
    a = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, term int")
    b = spark.createDataFrame([(*i, 2) for i in items], "item_id string, text string, rank int")
    return a.repartition(5), b


def test_against_plain(spark, monkeypatch):
    rnd = random.Random(3)
    letters = [f"w{k}" for k in range(60)] + ["Émile", "The", "THE", "the", "naïve", "x-ray", "日本"]
    prose = lambda n: " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    docs = [(k, prose(40)) for k in range(150)] + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "..."), (903, "w1 " * 30_000 + "w5")]
    items = [(str(k), prose(12)) for k in range(25)] + [("3", "w1 w2"), ("3", "w1 w2"), (None, "w3 The"), ("e", ""), ("n", None), ("none", "unseen words"), ("w", "w1 w2 w3")]
    want = plain(docs, items)
    a, b = made(spark, docs, items)
    assert sorted(map(tuple, ranked_search.search(a, b).collect()), key=repr) == want
    # blocks of items, few cells at once, heaps merged in groups
    monkeypatch.setattr(ranked_search, "CELLS", 10)
    monkeypatch.setattr(ranked_search, "WIDE", 2)
    assert sorted(map(tuple, ranked_search.search(a, b, block=40).collect()), key=repr) == want
    assert sorted(map(tuple, ranked_search.search(a, b, k=2).collect()), key=repr) == plain(docs, items, 2)


def test_empty_tables(spark):
    a, b = made(spark, [(1, "one two")], [("i", "one")])
    for docs, items in ((a.limit(0), b), (a, b.limit(0)), (a.filter("doc_id > 5"), b.limit(0))):
        out = ranked_search.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_ties_by_id(spark):
    a, b = made(spark, [(k, "same text here") for k in range(40, 0, -1)] + [(99, "other words")], [("i", "text")])
    assert [r["doc_id"] for r in ranked_search.search(a, b).orderBy("rank").collect()] == list(range(1, 11))
