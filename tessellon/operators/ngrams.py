"""Frequent word-boundary n-grams in two passes.

Pass 1 counts, by file, the eight characters at each word start. Pass 2 extends from starts whose
eight characters are frequent, to every word end within reach. An extension also stops short of the
first inner word start whose eight characters are not frequent: a pattern over it cannot be frequent
either. Both passes run over Arrow batches and hand on partial counts, so what is shuffled is a row
for each pattern, repo and task at most. ``pass1_native`` is the same census in built-in operators.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import MIN_CHARS, MIN_FREQUENCY, MIN_REPOS, MIN_TOKEN_SPAN, is_valid_ngram, is_word_boundary_start
from tessellon.operators.candidates import merge_results, score_counted, top
from tessellon.operators.frequent import frequent_patterns
from tessellon.operators.segments import safe_segments
from tessellon.session import drop, materialise, ship

# Thresholds of the two passes.
PASS1_THRESHOLD, MAX_PATTERN_LENGTH, GRAM = 15, 120, 8
#: Partial counts that a task holds before it hands them on.
HELD = 500_000
#: Survivors that go to every worker; beyond, pass 2 joins them (``pass2_native``).
MOST_SURVIVORS = 1_000_000
#: A score is guessed by so many characters, if there are so many times more; by patterns in such a share of their files, and in so many.
GUESSED_BY, LEAST_SHARE, SHARES_SEEN, LEAST_SEEN = 1 << 24, 8, (64, 256), 8

_STARTS = re.compile(r"(?<![A-Za-z0-9_])(?=(.{8}))", re.S)
_ENDS = re.compile(r"(?![A-Za-z0-9_])|$", re.S)


def _lines(text: str):
    for line in (text or "").split("\n"):
        line = line.strip(" \t\r")
        if len(line) >= MIN_CHARS:
            yield line


def _counts(held: Counter, names: list[str]):
    keys = list(held)
    cols = list(zip(*keys, strict=True)) if isinstance(keys[0], tuple) else [keys]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(held.values()), pa.int64())], names)


def _pass1(batches):
    held: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            held.update({g for line in _lines(text) for g in _STARTS.findall(line)})
            if len(held) >= HELD:
                yield _counts(held, ["gram", "n"])
                held = Counter()
    if held:
        yield _counts(held, ["gram", "n"])


def pass1(corpus: DataFrame, threshold: int = PASS1_THRESHOLD) -> DataFrame:
    """gram, frequency of the eight-character word starts in at least ``threshold`` files."""
    ship(corpus.sparkSession)
    parts = corpus.select("content").mapInArrow(_pass1, "gram string, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("frequency")).where(F.col("frequency") >= threshold)


def pass1_native(corpus: DataFrame, threshold: int = PASS1_THRESHOLD) -> DataFrame:
    """The same census with built-in operators only."""
    starts = safe_segments(corpus).select("file_id", "segment", F.explode(F.sequence(F.lit(0), F.length("segment") - GRAM)).alias("i"))
    grams = starts.where(is_word_boundary_start(F.col("segment"), F.col("i"))).select("file_id", F.substring("segment", F.col("i") + 1, F.lit(GRAM)).alias("gram"))
    return grams.distinct().groupBy("gram").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= threshold)


def _extensions(line: str, known: frozenset, longest: int):
    """The patterns of a line: from a frequent start to the word ends within reach."""
    grams = [(m.start(), m[1]) for m in _STARTS.finditer(line)]
    if not any(g in known for _, g in grams):
        return
    ends = [m.start() for m in _ENDS.finditer(line)]
    barrier = len(line) + GRAM  # start of the next infrequent gram
    for start, gram in reversed(grams):
        if gram in known:
            last = min(len(line), start + longest, barrier + GRAM - 1)
            i = bisect.bisect_left(ends, start + GRAM)
            while i < len(ends) and ends[i] <= last:
                yield line[start : ends[i]]
                i += 1
        else:
            barrier = start


def _pass2(known, longest):
    def run(batches):
        grams, held = known.value, Counter()
        for b in batches:
            for text, repo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update({(p, repo) for line in _lines(text) for p in _extensions(line, grams, longest)})
                if len(held) >= HELD:
                    yield _counts(held, ["pattern", "repo", "n"])
                    held = Counter()
        if held:
            yield _counts(held, ["pattern", "repo", "n"])

    return run


def pass2(corpus: DataFrame, survivors: DataFrame, max_length: int = MAX_PATTERN_LENGTH) -> DataFrame:
    """pattern, frequency, repo_count of extensions of the survivors. Exact for every pattern whose
    frequency reaches the survivors' threshold; rarer ones may be missing."""
    survivors = survivors.select("gram")
    grams = survivors.limit(MOST_SURVIVORS + 1).toArrow().column("gram")  # so many at most, in one run of pass 1
    if len(grams) > MOST_SURVIVORS:
        return pass2_native(corpus, survivors, max_length)
    ship(corpus.sparkSession)
    known = corpus.sparkSession.sparkContext.broadcast(frozenset(grams.to_pylist()))
    parts = corpus.select("content", "repo").mapInArrow(_pass2(known, max_length), "pattern string, repo string, n long")
    by_repo = parts.groupBy("pattern", "repo").agg(F.sum("n").alias("n"))
    return by_repo.groupBy("pattern").agg(F.sum("n").alias("frequency"), F.count("*").alias("repo_count"))


def pass2_native(corpus: DataFrame, survivors: DataFrame, max_length: int = MAX_PATTERN_LENGTH) -> DataFrame:
    """Pass 2 as a join of starts with survivors, for any number of them."""
    starts = safe_segments(corpus).select("file_id", "repo", "segment", F.explode(F.sequence(F.lit(0), F.length("segment") - GRAM)).alias("i"))
    starts = starts.where(is_word_boundary_start(F.col("segment"), F.col("i"))).select("file_id", "repo", F.substring("segment", F.col("i") + 1, F.lit(GRAM)).alias("gram"), F.substring("segment", F.col("i") + 1, F.lit(max_length + 1)).alias("rest"))
    rest = starts.join(survivors.select("gram"), "gram", "left_semi").select("file_id", "repo", "rest", F.explode(F.sequence(F.lit(GRAM), F.least(F.length("rest"), F.lit(max_length)))).alias("n"))
    ended = (F.col("n") == F.length("rest")) | ~F.substring("rest", F.col("n") + 1, F.lit(1)).rlike("[A-Za-z0-9_]")
    found = rest.where(ended).select("file_id", "repo", F.substring("rest", F.lit(1), F.col("n")).alias("pattern")).distinct()
    by_repo = found.groupBy("pattern", "repo").agg(F.count("*").alias("n"))
    return by_repo.groupBy("pattern").agg(F.sum("n").alias("frequency"), F.count("*").alias("repo_count"))


def scored_ngrams(corpus: DataFrame, min_frequency: int = MIN_FREQUENCY, min_repos: int = MIN_REPOS, min_tokens: int = MIN_TOKEN_SPAN, pass1_threshold: int = PASS1_THRESHOLD, max_length: int = MAX_PATTERN_LENGTH, least_score: int = 0) -> DataFrame:
    """pattern, frequency, token_count, score, repo_count of every n-gram that breaks no rule and scores ``least_score``.

    The census runs with the larger of both thresholds: a pattern is never in more files than its
    first eight characters, so the result is the same with far fewer survivors."""
    counted = frequent_patterns(corpus, max(pass1_threshold, min_frequency), max_length, least_score)
    rows = score_counted(counted, min_frequency, min_repos, min_tokens, is_valid_ngram(F.col("pattern")))
    return rows.where(F.col("score") >= least_score) if least_score > 0 else rows


def likely_score(corpus: DataFrame, n: int, min_repos: int = MIN_REPOS, min_tokens: int = MIN_TOKEN_SPAN, max_length: int = MAX_PATTERN_LENGTH) -> int:
    """A score that ``n`` n-grams are likely to reach: half of what some of the files let expect. 0 if there are
    too few files or repetitions to tell. A guess: whoever counts by it has to see whether so many do."""
    size = corpus.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    share = size // GUESSED_BY
    if share < LEAST_SHARE:
        return 0
    some = materialise(corpus.where(F.pmod(F.xxhash64("file_id"), F.lit(share)) == 0).select("content", "repo"), "some-files")
    files, guess = some.count(), 0
    for seen in dict.fromkeys(max(files // s, LEAST_SEEN) for s in SHARES_SEEN):  # few patterns are in many files: they are counted first
        best = top(scored_ngrams(some, seen, min_repos, min_tokens, seen, max_length), n).select("score").toArrow().column("score").to_pylist()
        if len(best) == n:
            guess = min(best) * share // 2
            break
    drop(some)
    return guess


def best_with(others: DataFrame, corpus: DataFrame, n: int, *limits, **named) -> DataFrame:
    """pattern, frequency, token_count, score of the best ``n`` rows of ``merge_results`` of scored candidates and
    ``scored_ngrams``, with its limits.

    A merged row's score is the better one of its pattern, so rows under the n-th best score may be left out of
    either channel (but repo counts may need them). That score is guessed; rows found by a guess have their exact scores, so if it was too high
    the n-th best of them is a sure bound for a second count."""
    best = lambda least: top(merge_results(others, scored_ngrams(corpus, *limits, least_score=least, **named)), n).drop("repo_count")
    least = likely_score(corpus, n)
    if not least:
        return best(0)
    found = materialise(best(least), "best")
    scores = found.select("score").toArrow().column("score").to_pylist()  # n at most
    sure = min(scores) if len(scores) == n else 0
    if sure >= least:
        return found
    drop(found)
    return best(sure)


def mine_ngrams(corpus: DataFrame, top_n: int = 1000, *limits, **named) -> DataFrame:
    """The best of ``scored_ngrams``, with its limits."""
    return top(scored_ngrams(corpus, *limits, **named), top_n)
