"""Operator 11 against a plain version; its query is compared with SQL in test_llm_queries."""

import random
import re
from collections import Counter

from cairnfield.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, top=2000, least=10):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        longer = [b for (x, v), b in candidates.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))] if len(w) == 2 else []
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))  # noqa: E741


def made(spark, docs):
    rows = [(k if k % 9 else None, text, lang, "x", 3) for k, (lang, text) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, rank int").repartition(5)


def corpus():
    rnd = random.Random(11)
    letters = ["the", "of", "Of", "and", "née", "x\x1fy", "日本", "a", "b", "\x0bc", "d\te"]
    prose = lambda n: "".join(rnd.choice(letters) + rnd.choice([" ", " ", " ", "  ", ". ", "\n", "\t"]) for _ in range(rnd.randint(0, n)))
    passage = " ".join(f"p{k}" for k in range(70))
    docs = [(rnd.choice(["en", "de", None, "und"]), prose(60)) for _ in range(120)]
    docs += [("en", f"start{k % 3} {passage} end{k % 4}") for k in range(25)] + [("fr", passage + " tail")] * 12 + [("fr", passage)] * 3
    docs += [("en", None), ("en", ""), ("en", "..."), ("en", " \t "), (None, "one two"), ("long", "go round " * 4000), ("long", "solo"), ("same", "q w e r t")] + [("same", "q w e r t")] * 30
    return docs


def test_against_plain(spark):
    docs = corpus()
    want = plain(docs)
    assert len(want) > 200
    for chunk_bytes in (6 << 20, 2000):
        assert sorted(map(tuple, collocations.collocations(made(spark, docs), chunk_bytes=chunk_bytes).collect())) == want


def test_parameters(spark):
    docs = corpus()[:140]
    assert sorted(map(tuple, collocations.collocations(made(spark, docs), top=7, least=3, chunk_bytes=500).collect())) == plain(docs, 7, 3)


def test_paths(spark):
    graph = collocations.cut(collocations.frequent(made(spark, corpus())))
    chains, inner = collocations.paths(graph.filter("kind = 3").drop("kind"), graph.filter("kind = 2").select("key", "lang", "phrase", "word1", "word2", "a"))
    found = {(r["lang"], r["a"]): r for r in chains.collect() if r["words"][0] == "p0"}
    # the passage is one path in each language; its first pair and its last pair are at its ends
    assert found["en", 25]["words"] == found["fr", 15]["words"] == [f"p{k}" for k in range(70)]
    assert len(found["en", 25]["steps"]) == 68 and inner.count() >= 2 * 67


def test_empty_tables(spark):
    assert collocations.collocations(made(spark, [("en", "a b")]).limit(0)).count() == 0
    out = collocations.collocations(made(spark, [("en", "a b"), ("en", None)]))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_large_counts(spark):
    row = spark.createDataFrame([(10**15 - 1, 10**15, 10**15)], "a long, l long, r long")
    assert row.selectExpr(collocations.SCORE.format(l="l", r="r")).first()[0] == 1000000 * (10**15 - 1) ** 2 // 10**30
