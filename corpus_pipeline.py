"""From documents to a training mix: five stages, each over all rows that the one before kept.

quality rules     rejects documents and removes failing lines
near-dedup        keeps one document of each group of near copies (five words, similarity 0.8 or more)
decontamination   drops documents that hold benchmark windows
secret scan       masks secrets in the texts
source mix        gives every document its copies, for the sources' target weights

All but the last return the columns of documents; the last adds size, source_size, target, copies and taken.
Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and empty tables: the quality stage rejects null and empty
texts (they have under ten words); the near-dedup keeps one row of repeated ones; null ids and sources are values of their own; an
empty table stays empty through all stages. Columns beyond those of documents are left behind by the first stage, so none can clash.

SQL cannot express the mix (an iterative dual), so there is no ORACLE_SQL; tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import decontaminate, mixture, near_dups, quality_rules, rows, secrets
from cairnfield.session import cut


#: Percent of similarity from which the near-dedup stage links texts.
SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, without their failing lines."""
    return quality_rules.clean(docs.select(*rows.DOCUMENT))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = SIMILAR) -> DataFrame:
    """One row of each group of near copies; rows without shingles all stay."""
    return near_dups.clean(docs, percent).select(*rows.DOCUMENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark; with an empty benchmark, all."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*rows.DOCUMENT)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked; null texts stay null."""
    return secrets.redact(docs).select(*rows.DOCUMENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the number of times that the mix takes each."""
    return mixture.mix(docs, rows.DOCUMENT).select(*rows.DOCUMENT, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dups", near_dups_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("source_mix", mix_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each cut off from the one before by files in the shared folder."""
    docs = rows.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
