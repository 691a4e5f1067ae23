"""Repo-weighted scoring of a dictionary on its corpus, and choices made from the scores.

Scores are rows (macro, kind, content, category, slots, score, file_count, repo_count). A macro's
score is the sum over repos of the tokens that it saves there by the repo's number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions.text import MACRO_RE, MAX_MACROS, expand_template, macro_token, token_count

# Thresholds and buckets of the reports.
FILE_THRESHOLDS = (0, 10, 50, 100, 200, 500, 1000, 2000, 5000)
REPO_THRESHOLDS = (1, 2, 3, 4, 5, 7, 10, 15, 20)
FILE_BUCKETS = ((0, 0), (1, 9), (10, 49), (50, 99), (100, 499), (500, 999), (1000, 4999), (5000, None))
RETENTION = 0.90


def occurrences(compressed: DataFrame, text: str = "compressed") -> DataFrame:
    """file_id, repo, macro (without arguments), args of every macro in a text."""
    rows = compressed.select("file_id", "repo", F.explode(F.regexp_extract_all(F.col(text), F.lit(MACRO_RE), F.lit(0))).alias("use"))
    number = F.regexp_extract("use", r"^<\|([MT]\d+)", 1)
    args = F.regexp_extract("use", r"^<\|T\d+:([^|]*)\|>$", 1)
    return rows.select("file_id", "repo", F.concat(F.lit("<|"), number, F.lit("|>")).alias("macro"), F.when(args != "", F.split(args, ",")).otherwise(F.array()).alias("args"))


def savings(uses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each use with the tokens that it saves: a pattern's less one; a template's, filled, less two
    and its arguments', commas included. A dictionary is bounded, and joined as such."""
    known = dictionary.select("macro", "kind", "content")
    saved = F.when(F.col("kind") == "M", token_count(F.col("content")) - 1).otherwise(token_count(expand_template(F.col("content"), F.col("args"))) - 2 - token_count(F.array_join("args", ",")))
    return uses.join(F.broadcast(known), "macro").withColumn("saved", saved)


def score_macros(compressed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The scores; only uses that save tokens count."""
    used = savings(occurrences(compressed), dictionary).where("saved > 0")
    by_file = used.groupBy("macro", "repo", "file_id").agg(F.sum("saved").alias("saved"))
    by_repo = by_file.groupBy("macro", "repo").agg(F.sum("saved").alias("saved"), F.count("*").alias("files"))
    sizes = compressed.groupBy("repo").agg(F.count("*").alias("repo_files"))
    scored = by_repo.join(sizes, "repo").groupBy("macro").agg(F.sum(F.col("saved") / F.col("repo_files")).alias("score"), F.sum("files").alias("file_count"), F.count("*").alias("repo_count"))
    return scored.join(F.broadcast(dictionary), "macro").select("macro", "kind", "content", "category", "slots", "score", "file_count", "repo_count")


def drop_reason(min_files: int, min_repos: int, max_entries: int) -> Column:
    """Over ranked scores with kept_before: the first rule that leaves an entry out, or ``kept``."""
    out = F.when(F.col("file_count") < min_files, "files").when(F.col("repo_count") < min_repos, "repos")
    return (out.when(F.col("place") > max_entries, "entries") if max_entries else out).otherwise("kept")


def ranked(scores: DataFrame, min_files: int = 0, min_repos: int = 0) -> DataFrame:
    """Scores with their place among those that pass both rules, best first."""
    passes = (F.col("file_count") >= min_files) & (F.col("repo_count") >= min_repos)
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(passes).orderBy(F.desc(F.round("score", 9)), "content")))


def rebuild_top_n(scores: DataFrame, min_files: int = 0, min_repos: int = 0, max_entries: int = 0) -> DataFrame:
    """A dictionary of the best entries, with fresh ids for each kind in order of rank."""
    kept = ranked(scores, min_files, min_repos).where(drop_reason(min_files, min_repos, max_entries) == "kept")
    ord_ = F.row_number().over(Window.partitionBy("kind").orderBy("place"))
    kept = kept.withColumn("ord", ord_).where(F.col("ord") <= MAX_MACROS)
    macro = F.when(F.col("kind") == "M", macro_token("M", F.col("ord"))).otherwise(macro_token("T", F.col("ord")))
    return kept.select("kind", "ord", "content", macro.alias("macro"), "slots", "category")


def drop_counts(scores: DataFrame, min_files: int = 0, min_repos: int = 0, max_entries: int = 0) -> DataFrame:
    return ranked(scores, min_files, min_repos).groupBy(drop_reason(min_files, min_repos, max_entries).alias("reason")).agg(F.count("*").alias("n"))


def refilter(scores: DataFrame, min_files: int = 0, max_entries: int = 999, min_repos: int = 0) -> DataFrame:
    """A new dictionary from stored scores, without mining again."""
    return rebuild_top_n(scores, min_files, min_repos, max_entries)


def file_buckets(scores: DataFrame) -> DataFrame:
    """bucket, n of entries by file count; empty buckets are left out."""
    label = None
    for lo, hi in FILE_BUCKETS:
        hit = (F.col("file_count") >= lo) if hi is None else F.col("file_count").between(lo, hi)
        name = f"{lo}+" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}"
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return scores.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def threshold_table(scores: DataFrame, thresholds: tuple[int, ...] = FILE_THRESHOLDS) -> DataFrame:
    """threshold, n, impact, pct: what each least file count would keep of the positive scores."""
    marks = scores.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    rows = scores.where("score > 0")
    passes = F.col("file_count") >= F.col("threshold")
    out = rows.join(F.broadcast(marks)).groupBy("threshold").agg(F.sum(passes.cast("long")).alias("n"), F.sum(F.when(passes, F.col("score")).otherwise(0.0)).alias("impact"), F.sum("score").alias("_all"))
    return out.select("threshold", "n", "impact", F.when(F.col("_all") > 0, F.col("impact") / F.col("_all")).otherwise(0.0).alias("pct"))


def auto_min_files(scores: DataFrame) -> DataFrame:
    """One row: the largest threshold that keeps at least 90 % of the impact; 0 without any."""
    return threshold_table(scores).agg(F.coalesce(F.max(F.when(F.col("pct") >= RETENTION, F.col("threshold"))), F.lit(0)).alias("min_files"))


def auto_stats(scores: DataFrame) -> DataFrame:
    """One row: the chosen threshold, how many entries it keeps and what share of the impact."""
    t = threshold_table(scores).where(F.col("pct") >= RETENTION)
    best = t.agg(F.max(F.struct("threshold", "n", "pct")).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0)).alias("min_files"), F.coalesce("b.n", F.lit(0)).alias("surviving"), F.coalesce("b.pct", F.lit(0.0)).alias("retained"))
