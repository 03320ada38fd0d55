"""Registered queries of the subpackage: against DuckDB where SQL can say them, and the pipeline's stages."""

import pytest
from compare import same
from pyspark.sql import functions as F

from cairnfield.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op3_language_id", "op5_secret_scan", "op6_lm_score", "op7_mix_sources", "op8_quality_model", "op9_quality_rules"):
        assert QUERIES[name](spark, sf).count() == n
    assert QUERIES["op10_token_counts"](spark, sf).agg({"n_docs": "sum"}).first()[0] == n


def test_pipeline(spark, sf):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import brute
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in p.STAGES] == ["quality_rules", "near_dups", "decontamination", "secrets", "source_mix"]
    quality, near, leaks, secrets, mix = (f for _, f in p.STAGES)
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    from cairnfield.session import cut

    one = cut(quality(spark, docs, sf))
    assert one.columns == columns and not any(brute.quality(t)[5] for _, t in rows(docs) if (_, t) in set(rows(one)))
    two = cut(near(spark, one, sf))
    assert two.columns == columns and sorted(d for d, _ in rows(two)) == sorted(x[0] for x in brute.near(rows(one), 80) if x[3])
    three = cut(leaks(spark, two, sf))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert three.columns == columns and sorted(d for d, _ in rows(three)) == sorted(x[0] for x in brute.decontaminate(rows(two), items) if not x[5])
    four = cut(secrets(spark, three, sf))
    assert four.columns == columns and four.count() == three.count() and not any(brute.secrets_base(t)[0] for _, t in rows(four))
    five = mix(spark, four, sf)
    assert five.filter("taken > 2 * size or taken <> copies * size").count() == 0
    whole = p.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "copies").collect())) == sorted(map(tuple, five.select("doc_id", "copies").collect()))


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(30)) + "."
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, prose(2), None, None, 1), (2, prose(2), None, None, 1), (3, prose(2), "en", "b", None), (None, prose(4), "en", "b", 5), (5, prose(5) + " " + "x" * 300_000, None, "a", 1), (6, "few words", "en", "a", 9)]
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, want in ((rows, [(2, 1), (5, 1), (None, 1)]), ([], [])):
        spark.createDataFrame(some, schema).withColumns({"size": F.lit("clash"), "node": F.lit(1)}).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = p.run(spark, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
        assert sorted(((r["doc_id"], 1) for r in out.collect()), key=repr) == want
