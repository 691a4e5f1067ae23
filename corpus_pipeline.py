"""A corpus pipeline: from ``documents`` to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; a stage's result
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

1. toxicity: a factorization machine, trained on the labels outside the held-out fold; documents
   that it scores one half or more go.
2. near_dedup: SimHash classes; the document of least id stays of each (nulls last, ties by the text's
   hash, then by that of the other columns).
3. secrets: every span found is masked; no document goes.
4. mixing: each source by its target weight; a document appears as often as the mix takes it.
5. sentencepiece: doc_id, n_pieces, ids and round_trip.

Empty tables pass through every stage. A null text is clean, near-duplicate to empty ones, has no
secrets and size 0, so that mixing leaves it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellon.llm import mixing, near_dedup, pieces, secret_scan, toxicity
from tessellon.llm.common import drop, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL has no factorization machine and no merging of pieces; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
