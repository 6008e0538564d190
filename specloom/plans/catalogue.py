"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specloom.plans import chemistry, curation, evaluation, functions, generation, ingest, rules, samples, sources

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (ingest, curation, rules, functions, evaluation, chemistry, samples, sources, generation)
QUERIES: dict[str, Query] = {name: run for part in PARTS for name, run in part.QUERIES.items()}
SQL: dict[str, str] = {name: text for part in PARTS for name, text in part.SQL.items()}
