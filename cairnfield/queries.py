"""Registry of the engine's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.plans import changes, documents, feeds, hierarchies, matching, serving, spaces, trails

_PLANS = (serving, documents, changes, spaces, hierarchies, trails, matching, feeds)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for plan in _PLANS for k, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for plan in _PLANS for k, sql in plan.ORACLES.items()}
