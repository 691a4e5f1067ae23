"""Windows of text around patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions.text import hash_order

# How many windows a pattern gets, and how far they reach.
NUM_CONTEXTS, CONTEXT_CHARS = 25, 300


def _positions(patterns: list[str], most: int):
    @F.pandas_udf("array<struct<pattern:string,pos:int>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = []
            for p in patterns:
                at = (t or "").find(p)
                n = 0
                while at >= 0 and n < most:
                    found.append({"pattern": p, "pos": at})
                    at, n = t.find(p, at + len(p)), n + 1
            out.append(found)
        return pd.Series(out)

    return find


def context_index(corpus: DataFrame, patterns: list[str], most: int = NUM_CONTEXTS, chars: int = CONTEXT_CHARS, seed: int = 42) -> DataFrame:
    """pattern, k, file_id, pos, window: the first ``most`` occurrences without overlaps, files in an
    order that a hash of their id makes. A file gives a pattern ``most`` at most, and the window's
    rank is one that Spark limits within tasks, before the shuffle."""
    rows = corpus.select("file_id", "content", F.explode(_positions(patterns, most)("content")).alias("p"))
    start = F.greatest(F.col("p.pos") - chars, F.lit(0))
    stop = F.col("p.pos") + F.length("p.pattern") + chars
    rows = rows.select("file_id", "p.pattern", "p.pos", F.substring("content", start + 1, stop - start).alias("window"))
    k = F.row_number().over(Window.partitionBy("pattern").orderBy(hash_order(F.col("file_id"), seed), "file_id", "pos"))
    return rows.withColumn("k", k).where(F.col("k") <= most).select("pattern", "k", "file_id", "pos", "window")
