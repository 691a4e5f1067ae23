"""The whole way from a corpus to a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.languages import Language, get_language
from tessellon.operators import candidates, codec, dictionary, ngrams, scoring, templates
from tessellon.operators.lexer import safe_corpus, safe_ranges_udf
from tessellon.session import drop, materialise

# How many entries a channel may hand on.
INTERNAL_LIMIT, MAX_TEMPLATES, MAX_STATEMENTS, MAX_ENTRIES = 10_000, 500, 1000, 999


def candidate_dictionary(corpus: DataFrame, language: str | Language, seeds: bool = True, use_ngrams: bool = True, use_templates: bool = True, use_statements: bool = True, min_frequency: int = 50, min_repos: int = 2, template_frequency: int = 30, safe: DataFrame | None = None) -> DataFrame:
    """Seeds, then exact candidates of both channels, then templates, then statement templates. Exact
    candidates come from safe zones only: a macro for what stands in a comment or a string is never used. ``safe`` is
    ``safe_corpus`` of the corpus, where a caller has it."""
    lang = get_language(language) if isinstance(language, str) else language
    spark = corpus.sparkSession
    safe = safe_corpus(corpus, lang) if safe is None else safe
    channels = []
    if seeds and lang.seeds:
        rows = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(lang.seeds)], "rank long, content string, category string")
        channels.append((rows, "M", "seed", None))
    exact = candidates.score_counted(candidates.regex_candidates(safe, lang.candidates), min_frequency, min_repos) if lang.candidates else None
    if use_ngrams:
        grams = ngrams.mine_ngrams(safe, INTERNAL_LIMIT, min_frequency, min_repos)
        exact = candidates.merge_results(exact, grams) if exact is not None else grams
    if exact is not None:
        channels.append((exact.select(F.col("pattern").alias("content"), (-F.col("score")).alias("rank")), "M", "mined", INTERNAL_LIMIT))
    for on, statements, cap, name in ((use_templates, False, MAX_TEMPLATES, "template"), (use_statements, True, MAX_STATEMENTS, "statement")):
        if on:
            rows = templates.mine_templates(corpus, lang, cap, statements, min_frequency=template_frequency, min_repos=min_repos)
            channels.append((rows.select(F.col("template").alias("content"), (-F.col("score")).alias("rank")), "T", name, cap))
    return dictionary.candidate_union(channels)


def compress_corpus(corpus: DataFrame, entries: DataFrame, language: str | Language | None = None, ident: str | None = None) -> DataFrame:
    """The corpus with ``compressed``: within safe zones if a language is named."""
    if language is None:
        return corpus.withColumn("compressed", codec.compressor(entries, ident or codec.IDENT)("content"))
    lang = get_language(language) if isinstance(language, str) else language
    return corpus.withColumn("compressed", codec.compressor(entries, lang.ident, zones=True)(F.col("content"), safe_ranges_udf(lang)("content")))


def build_dictionary(corpus: DataFrame, language: str | Language, auto: bool = True, min_files: int = 0, min_repos: int = 2, max_entries: int = MAX_ENTRIES, scores_path: str | None = None, **channels) -> tuple[DataFrame, DataFrame]:
    """(dictionary, scores): candidates of every channel, scored on the corpus, rebuilt from the best.
    ``auto`` chooses the least file count that keeps 90 % of the impact."""
    lang = get_language(language) if isinstance(language, str) else language
    safe = materialise(safe_corpus(corpus, lang), "safe")  # mining reads it several times
    entries = materialise(candidate_dictionary(corpus, language, min_repos=min_repos, safe=safe, **channels), "entries")
    drop(safe)
    scores = materialise(scoring.score_macros(compress_corpus(corpus, entries, language), entries), "scores")
    if scores_path:
        scores.write.mode("overwrite").parquet(scores_path)
    if auto:
        min_files = max(min_files, scoring.auto_min_files(scores).first()[0])
    return scoring.rebuild_top_n(scores, min_files, min_repos, max_entries), scores
