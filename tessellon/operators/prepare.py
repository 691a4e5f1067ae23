"""Training and evaluation splits without leaks, mixing compressed and plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import eval_repo_key, keep_by_hash

# The mix.
COMPRESS_RATIO, SEED, MIN_CONTENT = 0.75, 42, 50


def split(corpus: DataFrame, eval_repos: list[str]) -> DataFrame:
    """The corpus with split: ``eval`` for its repos, ``train`` for all others and for none."""
    return corpus.withColumn("split", F.when(F.coalesce(F.col("repo").isin(eval_repos), F.lit(False)), "eval").otherwise("train"))


def mix(compressed: DataFrame, eval_repos: list[str], ratio: float = COMPRESS_RATIO, seed: int = SEED, eval_only: bool = False) -> DataFrame:
    """file_id, repo, split, is_compressed, text: all of eval is compressed, ``ratio`` of train, which is
    left out with ``eval_only``."""
    rows = split(compressed, eval_repos)
    rows = rows.where("split = 'eval'") if eval_only else rows
    rows = rows.withColumn("is_compressed", (F.col("split") == "eval") | keep_by_hash(F.col("file_id"), ratio, seed))
    return rows.select("file_id", "repo", "split", "is_compressed", F.when(F.col("is_compressed"), F.col("compressed")).otherwise(F.col("content")).alias("text"), F.length("content").alias("original_chars"))


def meta(mixed: DataFrame, dictionary_size: int, ratio: float = COMPRESS_RATIO, seed: int = SEED, eval_repos: list[str] | None = None, eval_only: bool = False) -> DataFrame:
    """One row of run counters. The reduction is over train and eval, plain rows included, in percent; 0
    without a character. Files without text count as errors. ``eval_only`` leaves out what is about train.
    The split is by repo where any file has one."""
    train = F.col("split") == "train"
    count = lambda c: F.sum(c.cast("long"))
    known = F.coalesce(F.max((F.col("repo") != "unknown").cast("int")), F.lit(0)) == 1
    always = [
        F.lit(dictionary_size).alias("dictionary_size"), F.lit(ratio).alias("compress_ratio"), F.lit(seed).alias("seed"),
        F.when(known, "repo_balanced").otherwise("all_train").alias("split_method"), F.lit(eval_only).alias("eval_only"),
        F.lit(eval_repos or []).cast("array<string>").alias("eval_repos"), F.coalesce(count(~train & F.col("text").isNotNull()), F.lit(0)).alias("eval_files"),
        F.coalesce(count(F.col("text").isNull()), F.lit(0)).alias("errors"),
    ]
    read = F.col("text").isNotNull()
    reduction = F.coalesce((1 - F.sum(F.length("text")) / F.sum(F.when(read, F.col("original_chars")))) * 100, F.lit(0.0))
    more = [
        F.coalesce(count(train & read), F.lit(0)).alias("train_files"), F.coalesce(count(train & read & F.col("is_compressed")), F.lit(0)).alias("train_compressed"),
        F.coalesce(count(train & read & ~F.col("is_compressed")), F.lit(0)).alias("train_original"), reduction.alias("char_reduction_pct"),
    ]
    return mixed.agg(*always, *([] if eval_only else more))


def prepare_stream(records: DataFrame, eval_repos: DataFrame, compress, ratio: float = COMPRESS_RATIO, seed: int = SEED, key: str = "repo_name") -> DataFrame:
    """Records (record_id, content, repo_name), batch or streaming: short ones and those of
    evaluation repos (in either spelling) go, the rest are mixed. ``compress`` maps a column."""
    gone = eval_repos.select(eval_repo_key(F.col("repo")).alias("_k")).distinct()
    rows = records.where(F.length("content") >= MIN_CONTENT).withColumn("_k", eval_repo_key(F.coalesce(F.col(key), F.lit(""))))
    rows = rows.join(F.broadcast(gone), "_k", "left_anti")  # a configured list of repos
    rows = rows.withColumn("is_compressed", keep_by_hash(F.col("record_id"), ratio, seed))
    return rows.select("record_id", F.col(key), "is_compressed", F.when(F.col("is_compressed"), compress(F.col("content"))).otherwise(F.col("content")).alias("text"))


def capped(rows: DataFrame, most: int, by: str = "record_id") -> DataFrame:
    """The first ``most`` rows that were kept."""
    return rows.orderBy(by).limit(most)


def decompressed_eval(rows: DataFrame, decompress) -> DataFrame:
    """Evaluation rows with their plain text beside: file_id, text, plain."""
    return rows.select("file_id", "text", decompress(F.col("text")).alias("plain"))
