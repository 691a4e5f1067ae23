"""Helpers that the training-data operators share: table access, scratch tables (``materialise``, ``drop``), digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tessellon.session import clean_shuffles, drop, materialise, ship

#: Rows in one Arrow batch: documents are whole texts, so a batch stays at some megabytes.
ARROW_ROWS = 256

__all__ = ["ARROW_ROWS", "drop", "join_spans", "materialise", "sha256_hex", "table", "tune"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Ship the code, bound an Arrow batch by rows, since one row can hold a very long text, and let
    shuffle files go with the execution that made them."""
    ship(spark)
    clean_shuffles(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def join_spans(spans) -> str:
    """``kind:start:end`` of each span, comma-joined, in the order given."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
