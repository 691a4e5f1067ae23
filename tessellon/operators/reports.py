"""Reports on a dictionary's use: by repo, and what compression saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import hash_order, token_count
from tessellon.operators.scoring import REPO_THRESHOLDS, occurrences, savings


def macro_repos(compressed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """macro, content, repo_count of every entry; 0 where no repo uses it."""
    used = occurrences(compressed).select("macro", "repo").distinct().groupBy("macro").agg(F.count("*").alias("n"))
    return dictionary.join(used, "macro", "left").select("macro", "content", F.coalesce("n", F.lit(0)).alias("repo_count"))


def repo_histogram(per_macro: DataFrame) -> DataFrame:
    return per_macro.groupBy("repo_count").agg(F.count("*").alias("n"))


def repo_threshold_table(per_macro: DataFrame, thresholds: tuple[int, ...] = REPO_THRESHOLDS) -> DataFrame:
    """threshold, surviving, killed, pct of entries used by at least so many repos."""
    marks = per_macro.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    stays = F.sum((F.col("repo_count") >= F.col("threshold")).cast("long"))
    out = per_macro.join(F.broadcast(marks)).groupBy("threshold").agg(stays.alias("surviving"), F.count("*").alias("_n"))
    return out.select("threshold", "surviving", (F.col("_n") - F.col("surviving")).alias("killed"), (100.0 * F.col("surviving") / F.col("_n")).alias("pct"))


def repo_detail(per_macro: DataFrame, counts: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Entries used by exactly so many repos."""
    return per_macro.where(F.col("repo_count").isin(*counts)).select("repo_count", "macro", "content")


def sample(corpus: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` files in an order that a hash of the id makes: the same on any engine."""
    return corpus.orderBy(hash_order(F.col("file_id"), seed), "file_id").limit(size)


def measure(compressed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row of totals over rows (file_id, repo, content, compressed). Patterns count whether or
    not they save; templates only if they do."""
    used = savings(occurrences(compressed), dictionary).where("kind = 'M' OR saved > 0")
    totals = used.agg(
        F.sum(F.when(F.col("kind") == "M", F.col("saved")).otherwise(0)).alias("exact_saved"),
        F.sum(F.when(F.col("kind") == "T", F.col("saved")).otherwise(0)).alias("template_saved"),
        F.count("*").alias("n_macros"),
    )
    base = compressed.agg(F.count("*").alias("n_files"), F.sum(token_count(F.col("content")).cast("long")).alias("original_tokens"))
    zero = F.lit(0).cast("long")
    out = base.join(totals).select("n_files", F.coalesce("original_tokens", zero).alias("original_tokens"), F.coalesce("exact_saved", zero).alias("exact_saved"), F.coalesce("template_saved", zero).alias("template_saved"), "n_macros")
    saved = F.col("exact_saved") + F.col("template_saved")
    return out.select("*", saved.alias("saved"), F.when(F.col("original_tokens") > 0, saved / F.col("original_tokens")).otherwise(0.0).alias("ratio"), F.when(F.col("n_files") > 0, F.col("n_macros") / F.col("n_files")).otherwise(0.0).alias("macros_per_file"))
