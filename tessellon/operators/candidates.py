"""Regular-expression candidates, document frequencies, mining results and their merging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import MIN_CHARS, MIN_FREQUENCY, MIN_REPOS, MIN_TOKEN_SPAN, has_tokens, is_valid_pattern, strip, token_count


def leaping(regex: str) -> str:
    """An expression with the same matches that is not tried again inside a run of letters where it has
    failed. An expression that begins with a run of a class and a space has to take the run to its end, so
    it fails within a run if it fails where the run, or what the last match left of it, begins."""
    run = re.match(r"(\[[A-Za-z0-9_-]+\])\+(?= (?![*?{]))", regex)
    outer = re.sub(r"\\.|\[[^\]]*\]", "", regex)
    while (inner := re.sub(r"\([^()]*\)", "", outer)) != outer:
        outer = inner
    if not run or "|" in outer:
        return regex
    return rf"(?:(?<!{run[1]})|\G){run[1]}++{regex[run.end() :]}"


def candidates(text: Column, regexes: tuple[str, ...], valid=is_valid_pattern) -> Column:
    """The distinct valid matches of any expression: each scans on its own, so they may overlap."""
    found = [F.regexp_extract_all(text, F.lit(leaping(r)), F.lit(0)) for r in regexes]
    flat = F.transform(F.concat(*found), strip)
    return F.array_distinct(F.filter(flat, valid))


def document_frequency(rows: DataFrame, value: str) -> DataFrame:
    """value, frequency, repo_count over rows that hold a value once for each file. Counts by repo
    first: what is shuffled then is a row for each value and repo, not for each file."""
    by_repo = rows.groupBy(value, "repo").agg(F.count("*").alias("n"))
    return by_repo.groupBy(value).agg(F.sum("n").alias("frequency"), F.count("*").alias("repo_count"))


def regex_candidates(corpus: DataFrame, regexes: tuple[str, ...], valid=is_valid_pattern) -> DataFrame:
    """pattern, frequency, repo_count."""
    rows = corpus.select("repo", F.explode(candidates(F.col("content"), regexes, valid)).alias("pattern"))
    return document_frequency(rows, "pattern")


def scored_candidates(corpus: DataFrame, regexes: tuple[str, ...], *limits, **named) -> DataFrame:
    """``score_counted`` of ``regex_candidates``, with its limits: before they are counted, matches are
    told apart by length alone, and only those that are in enough files and repos are looked at further."""
    counted = regex_candidates(corpus, regexes, lambda m: F.length(m) >= MIN_CHARS)
    return score_counted(counted, *limits, valid=is_valid_pattern(F.col("pattern")), **named)


def rejection(min_frequency: int, min_repos: int, min_tokens: int, valid: Column | None = None) -> Column:
    """The first rule that a counted pattern breaks, or ``kept``."""
    out = F.when(F.col("frequency") < min_frequency, "frequency")
    if valid is not None:
        out = out.when(~valid, "invalid")
    return out.when(F.col("repo_count") < min_repos, "repos").when(token_count(F.col("pattern")) < min_tokens, "tokens").otherwise("kept")


def score_counted(counted: DataFrame, min_frequency: int = MIN_FREQUENCY, min_repos: int = MIN_REPOS, min_tokens: int = MIN_TOKEN_SPAN, valid: Column | None = None) -> DataFrame:
    """pattern, frequency, token_count, score, repo_count of what breaks no rule. Tokens are counted
    after the cheap rules, on distinct patterns: a condition on the pattern alone would be moved below
    the counting, to every match, so it depends on the counts."""
    often = (F.col("frequency") >= min_frequency) & (F.col("repo_count") >= min_repos)
    stays = F.when(often if valid is None else often & valid, F.col("pattern"))
    rows = counted.where(often).where(has_tokens(stays, min_tokens)).withColumn("token_count", token_count(F.col("pattern")))
    return rows.select("pattern", "frequency", "token_count", (F.col("frequency") * (F.col("token_count") - 1)).alias("score"), "repo_count")


def top(rows: DataFrame, n: int, by: str = "score", tie: str = "pattern") -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def mine_patterns(corpus: DataFrame, regexes: tuple[str, ...], top_n: int = 1000, **limits) -> DataFrame:
    return top(score_counted(regex_candidates(corpus, regexes), **limits), top_n)


def rejection_counts(counted: DataFrame, min_frequency: int = MIN_FREQUENCY, min_repos: int = MIN_REPOS, min_tokens: int = MIN_TOKEN_SPAN, valid: Column | None = None) -> DataFrame:
    return counted.groupBy(rejection(min_frequency, min_repos, min_tokens, valid).alias("reason")).agg(F.count("*").alias("n"))


def merge_results(*channels: DataFrame) -> DataFrame:
    """Mining results by pattern: the row of highest frequency, on ties that of the later channel,
    with the larger repo count."""
    tagged = [c.withColumn("_channel", F.lit(i)) for i, c in enumerate(channels)]
    rows = reduce(DataFrame.unionByName, tagged)
    best = F.max_by(F.struct("frequency", "token_count", "score"), F.struct("frequency", "_channel"))
    return rows.groupBy("pattern").agg(best.alias("b"), F.max("repo_count").alias("repo_count")).select("pattern", "b.frequency", "b.token_count", "b.score", "repo_count")
