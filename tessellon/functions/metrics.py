"""Text-similarity metrics and the aggregates over them.

Edit similarity, exact match, BLEU-4 and chrF are built-in expressions on a row: n-grams are arrays,
clipped counts come from counting within them. ``bleu4_udf`` and ``chrf_udf`` are the same in Arrow
batches, for long texts, where counting within arrays is quadratic.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def exact_match(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _ngrams(items: Column, n: int) -> Column:
    """Slices of ``n``, each as one text. Items are joined by a mark that splitting removes."""
    size = F.size(items)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(items, i, F.lit(n)), "\x1f"))).otherwise(F.array().cast("array<string>"))


def let(value: Column, make) -> Column:
    """``make(value)`` with the value worked out once, not once for each place that names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _clipped(a: Column, b: Column) -> Column:
    """How many of ``a`` can be matched with equal ones of ``b``, each used once."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bleu4(reference: Column, hypothesis: Column) -> Column:
    """Sentence BLEU-4 on white-space words; one is added to both counts from bigrams on, where there
    are any; any precision of zero makes it zero."""

    def precision(r, h, n):
        add = 0 if n == 1 else 1
        return let(F.struct(_ngrams(h, n).alias("h"), _ngrams(r, n).alias("r")), lambda g: F.when(F.size(g["h"]) > 0, (_clipped(g["h"], g["r"]) + add) / (F.size(g["h"]) + add)).otherwise(0.0))

    def score(t):
        r, h = t["r"], t["h"]
        brevity = F.least(F.lit(1.0), F.exp(1 - F.size(r) / F.size(h)))
        mean = let(F.array(*[precision(r, h, n) for n in range(1, 5)]), lambda p: F.when(F.exists(p, lambda x: x == 0), 0.0).otherwise(F.exp(F.aggregate(p, F.lit(0.0), lambda a, x: a + F.log(x) / 4))))
        return F.when((F.size(r) == 0) | (F.size(h) == 0), 0.0).otherwise(brevity * mean)

    return let(F.struct(words(reference).alias("r"), words(hypothesis).alias("h")), score)


def chrf(reference: Column, hypothesis: Column, most: int = 6) -> Column:
    """Mean F1 of character n-grams, over the lengths that both texts have."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")

    def f1(t, n):  # the harmonic mean of precision and recall; null where a side has no n-grams
        return let(F.struct(_ngrams(t["r"], n).alias("r"), _ngrams(t["h"], n).alias("h")), lambda g: F.when((F.size(g["r"]) > 0) & (F.size(g["h"]) > 0), 2.0 * _clipped(g["h"], g["r"]) / (F.size(g["r"]) + F.size(g["h"]))))

    def score(t):
        mean = let(F.filter(F.array(*[f1(t, n) for n in range(1, most + 1)]), lambda x: x.isNotNull()), lambda fs: F.when(F.size(fs) == 0, 0.0).otherwise(F.aggregate(fs, F.lit(0.0), lambda a, x: a + x) / F.size(fs)))
        return F.when((F.size(t["r"]) == 0) & (F.size(t["h"]) == 0), 1.0).otherwise(mean)

    return let(F.struct(chars(reference).alias("r"), chars(hypothesis).alias("h")), score)


def _bleu4(reference: str, hypothesis: str) -> float:
    r, h = reference.split(), hypothesis.split()
    if not r or not h:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (h, r))
        size, add = a.total(), int(n > 1)
        p = ((a & b).total() + add) / (size + add) if size else 0.0
        if not p:
            return 0.0
        logs += math.log(p) / 4
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(logs)


def _chrf(reference: str, hypothesis: str, most: int = 6) -> float:
    if not reference or not hypothesis:
        return float(reference == hypothesis)
    out = []
    for n in range(1, min(most, len(reference), len(hypothesis)) + 1):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (reference, hypothesis))
        out.append(2 * (a & b).total() / (a.total() + b.total()))
    return sum(out) / len(out)


@F.pandas_udf(DoubleType())
def bleu4_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([_bleu4(r or "", h or "") for r, h in zip(reference, hypothesis, strict=True)])


@F.pandas_udf(DoubleType())
def chrf_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([_chrf(r or "", h or "") for r, h in zip(reference, hypothesis, strict=True)])


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, median, stdev (0 for one row), n. Values are unrounded."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.count("value").alias("n"))


def perplexity(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Token-weighted perplexity over rows (loss, n_tokens): a text of one token or with a loss that
    is no number does not count; none at all is infinite."""
    good = (F.col("n_tokens") >= 2) & F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    w = F.when(good, F.col("n_tokens") - 1)
    total = F.sum(w)
    mean = F.sum(F.when(good, F.col("loss") * (F.col("n_tokens") - 1))) / total
    return rows.groupBy(*by).agg(F.coalesce(F.exp(mean), F.lit(float("inf"))).alias("perplexity"), F.coalesce(total, F.lit(0)).cast("long").alias("n_predicted"), F.sum(good.cast("long")).alias("n_texts"))


def config_analysis(results: DataFrame) -> DataFrame:
    """One row from rows (config, perplexity) of A, B, C, D: comprehension D/B, retention C to A and
    effect of compression B to A in percent."""
    p = results.groupBy().pivot("config", ["A", "B", "C", "D"]).agg(F.first("perplexity"))
    pct = lambda x, base: F.when(F.col(base) > 0, 100.0 * (F.col(x) - F.col(base)) / F.col(base)).otherwise(0.0)
    return p.select(F.when(F.col("B") > 0, F.col("D") / F.col("B")).otherwise(0.0).alias("comprehension"), pct("C", "A").alias("retention_pct"), pct("B", "A").alias("compression_pct"))


def config_comparison(summaries: DataFrame) -> DataFrame:
    """metric, delta_pct from rows (config, metric, mean) of A and B; 0 where A is 0."""
    p = summaries.groupBy("metric").pivot("config", ["A", "B"]).agg(F.first("mean"))
    return p.where("A IS NOT NULL AND B IS NOT NULL").select("metric", F.when(F.col("A") != 0, 100.0 * (F.col("B") - F.col("A")) / F.col("A")).otherwise(0.0).alias("delta_pct"))
