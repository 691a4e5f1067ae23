"""Safe zones of source code: what is no comment, string or character literal.

A scanner for each language reads a file once from left to right; documentation comments (and Python
docstrings) are safe. Offsets are code points everywhere, as in Spark's string functions. A file that
cannot be read is one safe range.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.languages import Language, get_language
from tessellon.session import ship


@lru_cache(32)
def _scanner(language: Language) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in (*language.strings, *language.comments)), re.S)


def unsafe_ranges(text: str, language: Language) -> list[tuple[int, int]]:
    """Comments, strings and literals that are no documentation, in order."""
    safe = language.is_safe
    return [m.span() for m in _scanner(language).finditer(text) if not (safe and safe(m[0], text, m.start()))]


def invert(ranges: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """The gaps in [0, total), overlapping and touching ranges merged."""
    out, at = [], 0
    for start, end in sorted(ranges):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, total)] if at < total else out


def safe_ranges(text: str, language: Language) -> list[tuple[int, int]]:
    try:
        return invert(unsafe_ranges(text, language), len(text))
    except (re.error, RecursionError):
        return [(0, len(text))] if text else []


def safe_ranges_udf(language: str | Language):
    """A column function text -> array of (start, end)."""
    lang = get_language(language) if isinstance(language, str) else language

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in safe_ranges(t or "", lang)] for t in texts])

    return ranges


def safe_text(text: str, language: Language) -> str:
    """The safe parts, one to a line."""
    return "\n".join(text[a:b] for a, b in safe_ranges(text, language))


def safe_corpus(corpus: DataFrame, language: Language) -> DataFrame:
    """The corpus with the safe parts of each file as its content. A language without comments and
    strings leaves it as it is."""
    if not (language.comments or language.strings):
        return corpus
    ship(corpus.sparkSession)

    @F.pandas_udf("string")
    def safe(texts: pd.Series) -> pd.Series:
        return pd.Series([safe_text(t or "", language) for t in texts], dtype=object)

    return corpus.withColumn("content", safe("content"))
