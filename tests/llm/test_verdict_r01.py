"""What VERDICT.md of round 1 found wrong or untested: collisions, neighbours, samples, races, long texts, models against plain Python."""

import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from cairnfield.llm import decontaminate, language, mixture, near_dups, perplexity, quality_model, quality_rules, secrets, substrings, token_counts, vec  # noqa: E402


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


ONE = thue_morse(10)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 8])
def test_texts_that_a_polynomial_confuses(spark, partitions):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, ONE), (2, TWO), (3, " ".join([*words, ONE, *words])), (4, " ".join([*words, TWO, *words])), (5, f"{ONE}\n{TWO}\n{' '.join(words)}"), (6, " ".join(ONE)), (7, " ".join(TWO))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert got(near_dups.scan(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(rows), key=repr)
    assert got(quality_rules.score(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((d, *brute.quality(t)) for d, t in rows), key=repr)
    assert got(substrings.scan(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(rows), key=repr)
    held, trained = (next(i for i in range(100) if (brute.rest(i, 7) == 2) == x) for x in (True, False))
    out = perplexity.scan(spark.createDataFrame([(held, ONE), (trained, TWO)], "doc_id long, text string")).filter("held_out").first()
    assert (out["n_tokens"], out["n_known"]) == (2, 1)


def test_hashes_tell_ranges_apart():
    rng = random.Random(4)
    parts = {"", "a", ONE, TWO, ONE + "a", "x" * 255, "x" * 256, "x" * 257, "x" * 600, *("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(3000))}
    data, ends = np.frombuffer("".join(sorted(parts)).encode(), np.uint8), np.cumsum([len(x) for x in sorted(parts)])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = vec.ranges(data, starts, ends)
    assert len(set(hashes.tolist())) == len(parts)
    assert (vec.ranges(np.concatenate([data[:5], data]), starts + 5, ends + 5) == hashes).all()
    for n in (1, 2, 3, 5, 8, 35, 64):
        few = vec.mix(np.array([rng.randint(0, 2) for _ in range(400)], np.uint64))
        by = {}
        for i, h in enumerate(vec.runs(few, n).tolist()):
            assert by.setdefault(h, few[i : i + n].tolist()) == few[i : i + n].tolist()
        assert len(by) == len({tuple(few[i : i + n].tolist()) for i in range(len(few) - n + 1)})


BORDER = [
    (1, "\n".join(" ".join(f"w{i}{j}" for j in range(12)) + "." for i in range(2)) + "\nand so it is that we like privacy"),
    (2, "policy scripts are small and we keep them so, as they are " + " ".join(f"v{j}" for j in range(9)) + "."),
    (3, ""), (4, None), (5, "click"), (6, "here are ten words or more of a text that is clean and stays."), (7, "sign in"),
]


def test_results_do_not_depend_on_the_rows_around(spark):
    df = spark.createDataFrame(BORDER, "doc_id long, text string")
    alone = sorted((d, bool(m["kept"][0]), int(m["lost_chars"][0])) for d, t in BORDER for m in [quality_rules.measure(pa.array([t or ""], pa.large_string()))])
    for n in (1, 2, 8):
        assert got(quality_rules.score(df.coalesce(1) if n == 1 else df.repartition(n)), "doc_id", "kept", "lost_chars") == alone
    assert dict((d, lost) for d, _, lost in alone)[7] == 6


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(20))) for i in range(50)], "doc_id long, text string")
    labels = spark.range(400_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = quality_model.fit(docs, labels)
    assert len(model["label"]) == sum(brute.rest(i, 3) != 1 for i in range(50))


def test_quality_model_by_hand(monkeypatch):
    """Terms, space and votes of a small sample in plain numpy, whole texts at a time."""
    rng = random.Random(3)
    some = ["", "one", *(" ".join(rng.choice(["Aa", "b1", "c.", "é", "dd", "EE"]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    texts = pa.array(some, pa.large_string())
    found = quality_model.terms(texts)
    monkeypatch.setattr(quality_model, "PIECE", 7)
    assert np.array_equal(found, quality_model.terms(texts))
    assert np.array_equal(found, np.vstack([quality_model.terms(pa.array([t], pa.large_string())) for t in some]))
    cells = [Counter(t.lower().split()) for t in some]
    for row, count in zip(found[:, quality_model.SHAPE :], cells, strict=True):
        assert sorted(np.round(np.expm1(row[row > 0])).astype(int).tolist()) == sorted(count.values())
    cosine = np.round(np.random.default_rng(1).normal(size=(6, 30)), 1)
    want = np.sort(np.argsort(-cosine, axis=1, kind="stable")[:, :9], axis=1)
    assert np.array_equal(np.sort(quality_model.nearest(cosine, 9), axis=1), want)


MISSED = [
    ("db_pwd = {}", "Zk3v9QwLm2"), ("db_pwd: {}", "Zk3v9QwLm2!"), ('db_pwd = """{}"""', "Zk3v9QwLm2"), ("db_pwd = '''{}'''", "Zk3v9QwLm2\nlineTwo"), ('db_pwd = "{}"', 'Zk3v9" + "QwLm2x7'), ("<db_pwd>{}</db_pwd>", "Zk3v9QwLm2"),
    ('token = K\nK = "{}"', "Zk3v9QwLm2"), ('a = K\nb = a\ntoken = b\nK = "{}"', "Zk3v9QwLm2"), ('dbpwd = "{}"', "Zk3v9QwLm2"), ('credential = "{}"', "Zk3v9QwLm2"), ('{{"secret": {{"value": "{}"}}}}', "Zk3v9QwLm2"),
    ("signing_key:\n  value: {}\nname: x", "Zk3v9QwLm2"), ('<add key="db_pwd" value="{}"/>', "Zk3v9QwLm2"), ('{{"a": {{"b": 1}}, "pwd": {{"data": "{}"}}}}', "Zk3v9QwLm2"),
]


@pytest.mark.parametrize("form,secret", MISSED)
def test_secrets_that_were_missed(form, secret):
    text = form.format(secret)
    assert [text[lo:hi] for lo, k, hi in secrets.spans(text)[1] if k == 3] == [secret]


@pytest.mark.parametrize("text", ["<p>a1 is a token</p>", 'tokenizer = "Zx9_qP3rT7vW1yB5"', '{"token": {"id": "Zx9_qP3rT7vW1yB5"}}', 'pwd:\nvalue: Zx9qP3rT7vW1', 'x = {"pwd": {}}\nvalue = "Zx9qP3rT7vW1"', 'token = k\nk = f(x)\nk2 = "Zx9qP3rT7vW1"'])
def test_no_secrets_beside_sensitive_names(text):
    assert not secrets.spans(text)[1]


def test_secrets_are_bound_over_a_table(spark):
    df = spark.createDataFrame(list(enumerate(f.format(x) for f, x in MISSED)), "doc_id long, text string")
    assert secrets.scan(df).agg(F.sum("n_bound")).first()[0] == len(MISSED)


@pytest.mark.parametrize("unit", ["<a>", "a={", 'a="""', "a=b\n", "a=x'+", "a:\n ", "key='a' value='", "a{}=b;"])
def test_lexing_stays_linear(unit):
    import time

    took = []
    for n in (20_000, 200_000):
        text = "signing_key = " + "".join(unit.replace("{}", str(i)) for i in range(n // len(unit)))
        begun = time.process_time()
        secrets.bound_spans(text)
        took.append(time.process_time() - begun)
    assert took[1] < 30 * took[0] + 0.5
    secrets.bound_spans("signing_key=x\n" + "".join(f"a{i} = a{i + 1}\n" for i in range(5000)) + 'a5000 = "Zx9_qP3rT7vW1yB5"')


def naive_bayes(rows):
    """Language by all grams of a text, in dictionaries."""
    cells = lambda t: [c for piece in language.pieces(t) for part in piece for c in part.tolist()]
    train = [(cells(t), lang) for d, t, lang in rows if t is not None and lang is not None and brute.rest(d, 4) != 2]
    counts, texts = {}, Counter(lang for _, lang in train)
    for found, lang in train:
        counts.setdefault(lang, Counter()).update(found)
    out = []
    for d, t, _ in rows:
        if not any(map(str.isalpha, t or "")) or not texts:
            out.append((d, "und", 0.0))
            continue
        found, best = cells(t), {}
        for lang in sorted(texts):
            total = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
            best[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][c] + language.SMOOTHING) / total) for c in found)
        top = max(best, key=best.get)
        out.append((d, top, 1 / sum(math.exp(x - best[top]) for x in best.values())))
    return out


@pytest.mark.parametrize("cells", [language.MAX_CELLS, 2 * language.BUCKETS])
def test_language_by_hand(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "MAX_CELLS", cells)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))), lang) for i in range(90) for lang, alphabet in [rng.choice([("aa", "abc "), ("bb", "bcd é"), ("cc", "xyz."), ("dd", "日本 "), (None, "q")])]]
    rows += [(None, "abc", "aa"), (200, None, "aa"), (201, "123", "bb"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    have = got(language.predict(df, language.fit(df)), "doc_id", "lang_pred", "score")
    want = sorted(naive_bayes(rows), key=repr)
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert [x[2] for x in have] == pytest.approx([x[2] for x in want], rel=1e-3)


def test_grams_are_the_same_in_pieces(monkeypatch):
    text = "The Ünïcode text 日本 " * 20
    want = sorted(c for p in language.pieces(text) for part in p for c in part.tolist())
    for n in (1, 2, 3, 50):
        monkeypatch.setattr(language, "PIECE", n)
        assert sorted(c for p in language.pieces(text) for part in p for c in part.tolist()) == want


def test_interpolated_scores_by_hand(spark, monkeypatch):
    """Scores under the learned weights, with all n-gram counts in dictionaries."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "zz a zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in perplexity.scan(df, 500).collect()}
    uni, bi, tri, contexts, context = Counter(), Counter(), Counter(), Counter(), Counter()
    tokens = {d: [*brute.words(t, True), None] for d, t in rows}
    for d, ts in tokens.items():
        if brute.rest(d, 7) == 2:
            continue
        for a, b, c in zip([0, 0, *ts], [0, *ts], ts, strict=False):
            uni[c] += 1
            bi[b, c] += 1
            tri[a, b, c] += 1
            contexts[a, b] += 1
            context[b] += 1
    n, v = sum(uni.values()), len(uni)
    # a mixture of the estimates lies between the least weight of the least and the largest of them
    for d, ts in tokens.items():
        most = least = 0.0
        for a, b, c in zip([0, 0, *ts], [0, *ts], ts, strict=False):
            p = [tri[a, b, c] / contexts[a, b] if contexts[a, b] else 0, bi[b, c] / context[b] if context[b] else 0, uni[c] / n, 1 / (v + 1)]
            most += math.log10(max(p))
            least += math.log10(max(min(p[2:]) * 1e-6, 1e-12))
        r = out[d]
        assert least <= r["score"] <= most + 1e-9
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(uni[x] > 0 for x in ts), n)


def test_estimates_of_a_chunk_by_hand():
    rows = pa.table({"doc_id": [1, 2, 3], "text": ["a b a b c", "b a b", None], "train": [True, True, True], "held_out": [False] * 3})
    chunk = perplexity.Chunk(rows, 1 << 20)
    bucket, three, two, one = chunk.estimates({name: chunk.counts(name) for name in perplexity.NAMES})
    texts = [[*(t or "").split(), None] for t in ["a b a b c", "b a b", None]]
    grams = [(x, y, z) for t in texts for x, y, z in zip(["s", "s", *t], ["s", *t], t, strict=False)]
    uni, bi, tri = Counter(g[2] for g in grams), Counter(g[1:] for g in grams), Counter(grams)
    c2, c1 = Counter(g[:2] for g in grams), Counter(g[1] for g in grams)
    assert one.tolist() == [uni[z] for _, _, z in grams]
    assert two.tolist() == [bi[y, z] / c1[y] for _, y, z in grams]
    assert three.tolist() == [tri[x, y, z] / c2[x, y] for x, y, z in grams]
    assert bucket.tolist() == [1 + int(math.log2(c2[x, y])) for x, y, _ in grams]


def test_weights_by_hand():
    """Expectation-maximisation of one bucket, against the likelihood on a grid."""
    rng = np.random.default_rng(3)
    estimate, n = rng.uniform(0, 0.2, (40, 4)), rng.integers(1, 30, 40).astype(float)
    estimate[:, 3] = 0.01
    w = perplexity.learn(np.full(40, 2), n, estimate)[2]
    likelihood = lambda x: (n * np.log(estimate @ x)).sum()
    grid = [np.array([a, b, c, 20 - a - b - c]) / 20 for a in range(21) for b in range(21 - a) for c in range(21 - a - b) if 20 - a - b - c]
    assert likelihood(w) >= max(map(likelihood, grid)) - 0.05


def test_rates_are_tilted_and_meet_their_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice("abc")) for i in range(3000)]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, some in out.groupby("source"):
        some = some[some["size"] > 0]
        assert (some["rate"] * some["size"]).sum() == pytest.approx(some["target"].iloc[0], rel=1e-5)
        free = some[some["rate"] < 2 - 1e-9]
        slope = np.log(free["rate"]) / free["size"]
        assert free.empty or slope.max() - slope.min() < 1e-6


def test_unsolved_mixes_raise(spark, monkeypatch):
    monkeypatch.setattr(mixture, "STEPS", 1)
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError):
        mixture.mix(df).count()


def test_a_batch_committed_during_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    import public_tokenizers

    path, root = str(public_tokenizers.path(token_counts.FILE)), str(tmp_path / "store")
    batch = lambda *texts: spark.createDataFrame([(t, "en", "a", 1) for t in texts], "text string, lang string, source string, sign int")
    docs = lambda: token_counts.totals(spark, root).agg(F.sum("n_docs")).first()[0]
    token_counts.commit(batch("one", "two"), root, "b1", "v1", path)
    real = token_counts.totals

    def between(spark_, root_, snapshot=None):
        if snapshot is not None:
            monkeypatch.setattr(token_counts, "totals", real)
            assert token_counts.commit(batch("three"), root, "b2", "v1", path)
        return real(spark_, root_, snapshot)

    monkeypatch.setattr(token_counts, "totals", between)
    token_counts.compact(spark, root)
    assert docs() == 3
    token_counts.compact(spark, root)
    assert docs() == 3 and not token_counts.commit(batch("three"), root, "b2", "v1", path)
    # two writers of one batch, and a writer that died before its record
    monkeypatch.setattr(token_counts, "committed", lambda s, r: s.createDataFrame([], "batch string"))
    for _ in range(2):
        token_counts.commit(batch("four"), root, "b3", "v1", path)
    monkeypatch.undo()
    token_counts.delta(batch("five"), "v1", path).write.parquet(f"{root}/deltas/{token_counts._new()}")
    assert docs() == 4
    token_counts.compact(spark, root)
    assert docs() == 4


def test_token_query_nets_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("sign", F.lit(1))
    import public_tokenizers

    want = token_counts.delta(docs, token_counts.TOKENIZER, str(public_tokenizers.path(token_counts.FILE)))
    assert got(token_counts.query(spark, sf), *token_counts.KEYS, *token_counts.SUMS) == got(want, *token_counts.KEYS, *token_counts.SUMS)


def test_decontamination_of_large_benchmarks(spark, monkeypatch):
    """Windows that are shuffled, in rounds of few tokens; one that many items share."""
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 14])))) for i in range(60)] + [(100 + i, "shared words of a window") for i in range(40)]
    docs = [(i, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), *rng.choice(items)[1].split(), "end"])) for i in range(50)] + [(None, None), (7, "")]
    monkeypatch.setattr(decontaminate, "BLOCK", 5)
    monkeypatch.setattr(decontaminate, "SMALL", 9)
    have = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string"))
    assert got(have, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.decontaminate(docs, items), key=repr)


LONG = """
import random, resource, sys
import pyarrow as pa
from cairnfield.llm import language, near_dups, quality_model, quality_rules, secrets, substrings
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
line = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(4000)]
text = pa.array(["\\n".join(rng.choice(line) for _ in range(32 * 2**20 // 80)), "x" * 2**23], pa.large_string())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{0}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("call,most", [("quality_rules.measure(text)", 900), ("near_dups._signed(text, 20)", 1300), ("quality_model.terms(text)", 1100), ("[len(c) for t in text.to_pylist() for p in language.pieces(t) for c in p]", 700), ("[secrets.spans(t) for t in text.to_pylist()]", 700)])
def test_very_long_texts_take_bounded_memory(call, most):
    """Megabytes beyond a text of 32 MB of prose and a word of 8 MB."""
    done = subprocess.run([sys.executable, "-c", LONG.format(call)], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.strip().splitlines()[-1]) < most


def test_repeated_rows_get_equal_results(spark):
    rows = [(1, "pwd: Zx9qP3rT7vW1 and some words"), (1, "pwd: Zx9qP3rT7vW1 and some words"), (2, "other words"), (2, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for out in (secrets.scan(df), language.predict(df, language.fit(df)), quality_model.predict(df, quality_model.fit(df, labels))):
        assert out.count() == 4 and out.distinct().count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_line_rules_by_hand(spark, seed):
    rng = random.Random(seed)
    parts = ["word", "Word", "ÉTÉ", "LOUD", "|", "###", "$5", "click here", "sign in", "privacy policy", "javascript", "javascripts", "xclick here", "日本語。", "fin.", "end", "a|b", "all rights reserved", "\t", "terms of use,"]
    line = lambda: " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 4, 12, 40])))
    rows = []
    for i in range(150):
        lines = [line() for _ in range(rng.randint(0, 8))]
        lines += rng.sample(lines, min(len(lines), rng.choice([0, 0, 2]))) + [" ".join(f"x{rng.random()}" for _ in range(rng.choice([0, 30, 60])))]
        rows.append((i, "\n".join(lines)))
    out = got(quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "lost_chars", "kept")
    assert out == sorted(((d, *brute.line_verdict(t, quality_rules.CLOSING)) for d, t in rows), key=repr)
    assert {k for *_, k in out} == {True, False}
