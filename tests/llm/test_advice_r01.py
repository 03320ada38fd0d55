
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from cairnfield.llm import mixture, near_dups, quality_model, quality_rules, secrets  # noqa: E402


def near_at(rows, percent):
    """Ids that a near-dedup at a threshold keeps, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (brute.words(t, True) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


@pytest.mark.parametrize("seed", range(2))
def test_near_stage_links_from_four_fifths(spark, seed):
    import corpus_pipeline as p

    rng = random.Random(seed)
    rows = []
    for i in range(40):  # pairs, and some chains, around the threshold
        w = [f"w{i}x{k}" for k in range(rng.choice([60, 150]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(2):
            w = [*w]
            for k in rng.sample(range(0, len(w), 6), max(1, round(len(w) * rng.choice([0.015, 0.019, 0.021, 0.024])))):
                w[k] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in p.STAGES[1][1](spark, df, "", percent=80).select("doc_id").collect())
    assert kept == near_at(rows, 80) != near_at(rows, 85)
    assert sorted(r["doc_id"] for r in near_dups.scan(df, 85).filter("kept").collect()) == near_at(rows, 85)


def test_near_bounds_follow_the_similarity():
    assert [near_dups.n_bands(x) for x in (85, 80)] == [20, 28]
    rng = random.Random(5)
    for percent in (80, 85):
        bits = []
        for _ in range(400):
            odd = [0] * near_dups.SKETCH
            for _ in range(near_dups.SAMPLES):
                if rng.random() > percent / 100:
                    for _ in range(2):
                        odd[rng.randrange(near_dups.SKETCH)] ^= 1
            bits.append(sum(odd))
        mean = sum(bits) / len(bits)
        sd = (sum((b - mean) ** 2 for b in bits) / len(bits)) ** 0.5
        assert near_dups.most_bits(percent) == pytest.approx(mean + 6 * sd, rel=0.06)
    with pytest.raises(ValueError):
        near_dups.n_bands(70)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeiourst") for _ in range(6)) for _ in range(n))


CLEAN = [
    f"{prose(1, 40)} design in steel, assign up to two, javascriptish {prose(2, 20)}.",
    f"{prose(3, 60)} he wrote it in JavaScript {prose(4, 60)}, and one may click here to sign in to it {prose(5, 60)}.",
    "\n".join(f"{x}今天的天气很好我们去山上看日出{x}。" for x in "一二三四五六七八九十百千"),
    "\n".join(f"これは{x}番目の静かな文です{mark}" for x, mark in zip("一二三四五六七八九十百千", "。！？」』）…”’»。．")),
    "\n".join(f"यह {x} है।" for x in "कखगघचछजझटठडढ"),
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_kept_whole(text):
    import pyarrow as pa

    out = quality_rules.measure(pa.array([text], pa.large_string()), cleaned=True)
    assert (out["cleaned"][0].as_py(), bool(out["kept"][0]), int(out["lost_chars"][0])) == (text, True, 0)


def test_boilerplate_lines_still_fail():
    import pyarrow as pa

    body = "\n".join(prose(k, 20) + "." for k in range(5))
    lines = ["Please enable JavaScript to go on.", "Copyright 2020, all rights reserved.", "Sign in | or (sign up)", "Read our privacy policy and our terms of use, and subscribe to our letters.", "更多新闻", "naïveté"]
    out = quality_rules.measure(pa.array(["\n".join([*lines, body])], pa.large_string()), cleaned=True)
    assert out["cleaned"][0].as_py() == body


LONG = "".join(random.Random(9).choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ123456789+/", k=5000))
FOUND = [
    ('private_key = "{}"', LONG[:700]), ("private_key: '{}'", LONG), ("x" * 300 + '_signing_key = "{}"', LONG[:40]), ("pwd: {}", "Zx9qP3rT7vW1"), ("user: bob\nSIGNING_KEY={}\nx=1", "Zx9qP3rT7vW1"), ("[db]\n  pwd = {}  # theirs\n", "Zx9qP3rT7vW1"),
    ("export SIGNING_KEY={}\r\n", "Zx9qP3rT7vW1"), ("k: https://x.org/?signing_key={}&a=b", "Zx9qP3rT7vW1"), ("pwd: {}", "a:b=c,D9!xyz"), ("pwd: {}", "sunshine2024"), ("SIGNING_KEY=a\npwd: {}", "eyJhbGci1x.eyJzdWIi2yZ.sIg9nAtUre"),
    ('k = "{}"; token = k', "Zx9_qP3rT7vW1yB5"), ('k = "{}"\ncredentials = k', "Zx9_qP3rT7vW1yB5"), ('k = "{}"\nbearer = k', "Zx9_qP3rT7vW1yB5"), ('DB_PASS = "{}"', "Zx9_qP3rT7vW1yB5"), ("K={}\nsigning_key = K", "Zx9qP3rT7vW1"),
]


@pytest.mark.parametrize("form,secret", FOUND)
def test_secrets_of_every_form(form, secret):
    text = form.format(secret)
    assert [text[lo:hi] for lo, k, hi in secrets.spans(text)[1] if k == 3] == [secret]


@pytest.mark.parametrize("text", ["pwd = get_pwd1(x)", "pwd: ${DB_PWD1}", "pwd = cfg1.pwd2", "pwd = user_pwd2", 'token_url = "https://a.org/b1C"', "pwd: string", "if pwd == Zx9qP3rT7vW1: x", "signing_key: /etc/keys/a1.pem", 'k = "Zx9_qP3rT7vW1yB5"\nk = "none"\ntoken = k'])
def test_no_secrets_in_references(text):
    assert not secrets.spans(text)[1]


def test_lexing_is_linear():
    import time

    for unit in ('a="a=', "a=", "pwd:", "a='\\", "a" * 50, "pwd: Zx9qP3rT7vW1=", "/a"):
        took = []
        for n in (20_000, 200_000):
            begun = time.process_time()
            secrets.bound_spans(f"signing_key = {unit * (n // len(unit))}")
            took.append(time.process_time() - begun)
        assert took[1] < 30 * took[0] + 0.5


def test_mix_carries_the_error_over_a_whole_source(spark):
    """A few long documents among many short ones in one source, and many documents of one size in another: totals end at the targets."""
    rows = [(i, " ".join(["w"] * (2000 if i % 500 == 0 else 2)), "b") for i in range(6000)] + [(10_000 + i, "w w w", "a") for i in range(5000)] + [(20_000, "w " * 50_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixture.mix(df).cache()
    assert out.count() == len(rows) and out.filter("copies < floor(rate) or copies > ceil(rate) or taken <> copies * size").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.sum(F.col("rate") * F.col("size")).alias("wanted")).collect():
        assert r["wanted"] == pytest.approx(r["target"], rel=1e-5)
        assert abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1e-5 * r["target"]


def test_allotments_stay_within_half_the_largest():
    import numpy as np

    rng = np.random.default_rng(4)
    for groups in (1, 50, 5000):
        size, n, rates = np.array([100_000, 100]), np.array([groups, 1000 * groups]), np.array([0.4, 0.99])
        low, extra = mixture.allotted(size, rates, n)
        assert abs(((low * n + extra) * size).sum() - (rates * n * size).sum()) <= 50_000
        size = np.unique(rng.integers(1, 10_000, 300))[::-1]
        n, rates = rng.integers(1, 10 * groups, len(size)), rng.uniform(0, 2, len(size))
        low, extra = mixture.allotted(size, rates, n)
        assert (extra <= n).all() and abs(((low * n + extra) * size).sum() - (rates * n * size).sum()) <= size[0] / 2


def test_quality_is_learned_from_words(spark):
    """Texts of one shape, whose labels only their words tell."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common, good, bad = ([word() for _ in range(n)] for n in (300, 40, 40))
    rows = []
    for i in range(900):
        w = [rng.choice(common) for _ in range(40)]
        for k in rng.sample(range(40), 8):
            w[k] = rng.choice(good if i % 2 else bad)
        rows.append((i, " ".join(w) + ".", i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = quality_model.fit(df, df.select("doc_id", "quality"))
    out = quality_model.predict(df, model).join(df.select("doc_id", "quality"), "doc_id").filter(quality_model.rows.held_out("doc_id", *quality_model.HELD_OUT))
    assert out.filter("predicted = quality").count() / out.count() > 0.9


def test_mix_of_long_documents_spread_over_groups(spark):
    """About one long document of rate under 0.5 a group, and short ones that have no room to make up for it."""
    rows = [(i, "w", "b") for i in range(16_000)] + [(20_000 + i, "w " * 818, "b") for i in range(16)] + [(30_000, "w " * 21_817, "a"), (30_001, "w " * 21_817, "c")]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).filter("source = 'b'")
    r = out.agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).first()
    assert abs(r["taken"] - r["target"]) <= 818 / 2
