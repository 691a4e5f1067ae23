"""Query registry of the engine's own operators: name -> (spark, sf_dir) callable, and SQL oracles.

Queries run on ``documents``: a document is a file, its source a repo. Each oracle is the same result
in SQL that DuckDB runs on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellon.operators import ngrams
from tessellon.plans import code, corpus, evaluation, mining, scoring
from tessellon.sources.corpus import documents

_PARTS = (corpus, mining, scoring, evaluation, code)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: n-grams in two passes, scored. The smallest corpus needs a lower frequency."""
    return ngrams.mine_ngrams(documents(spark, sf_dir), min_frequency=15)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
