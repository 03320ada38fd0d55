"""The subpackage's queries and, where SQL can say them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import byte_bpe, collocations, decontaminate, language, mixture, near_dups, perplexity, quality_model, quality_rules, ranked_search, secrets, substrings, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.query,
    "op2_substring_dedup": substrings.query,
    "op3_language_id": language.query,
    "op4_near_dups": near_dups.query,
    "op5_secret_scan": secrets.query,
    "op6_lm_score": perplexity.query,
    "op7_mix_sources": mixture.query,
    "op8_quality_model": quality_model.query,
    "op9_quality_rules": quality_rules.query,
    "op10_token_counts": token_counts.query,
    "op11_collocations": collocations.query,
    "op12_ranked_search": ranked_search.query,
    "op13_byte_bpe": byte_bpe.query,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_substring_dedup": substrings.ORACLE,
    "op4_near_dups": near_dups.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
}
