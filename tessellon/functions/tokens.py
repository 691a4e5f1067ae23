"""Token counters and token arrays: the default expression, or a tokenizer file in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.functions.text import TOKEN, token_count


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def counter(tokenizer_file: str | None = None):
    """A column function text -> number of tokens: the default expression, or that of a tokenizer
    file, read once by each worker."""
    if tokenizer_file is None:
        return token_count

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)])

    return count


def truncate(token_array: Column, most: int) -> Column:
    return F.slice(token_array, 1, most)


def trim_to(reference: Column, generated: Column) -> Column:
    """As many of the reference's tokens as were generated: a shorter answer is held to no more."""
    return F.slice(reference, F.lit(1), F.size(generated))


def prefix_suffix(token_array: Column, ratio: float = 0.5, min_tokens: int = 32, max_prefix: int = 512) -> Column:
    """struct(prefix, suffix) of token arrays; null if the text is too short or a side is empty."""
    n = F.size(token_array)
    at = F.least(F.floor(n * F.lit(ratio)).cast("int"), F.lit(max_prefix))
    return F.when((n >= min_tokens) & (at >= 1) & (at < n), F.struct(F.slice(token_array, F.lit(1), at).alias("prefix"), F.slice(token_array, at + 1, n - at).alias("suffix")))


def find_span(token_array: Column, wanted: Column) -> Column:
    """0-based place of the first occurrence of ``wanted``; null without one. Both sides become
    text between marks that tokens do not hold, so that one search of text finds it."""
    mark = "\x1f"
    whole = lambda a: F.concat(F.lit(mark), F.array_join(a, mark), F.lit(mark))
    text = whole(token_array)
    at = F.instr(text, whole(wanted))
    before = F.substring(text, F.lit(1), at)
    return F.when((F.size(wanted) > 0) & (at > 0), F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit(""))) - 1)


def expansion(kind: Column, content: Column) -> Column:
    """The text that stands for a macro: its pattern, or a template without slots and blanks around."""
    return F.when(kind == "M", content).otherwise(F.trim(F.regexp_replace(content, r"\{\d+\}", "")))


def new_token_ids(token_map: Column) -> Column:
    """token -> id without the entries that start with an underscore."""
    return F.map_filter(token_map, lambda k, _: ~k.startswith("_"))


def validate_vocab(token_map: Column, original_size: Column, vocab_size: Column) -> Column:
    """Whether ids start where the original vocabulary ends and fill the new one."""
    ids = F.map_values(new_token_ids(token_map))
    return (vocab_size > original_size) & (F.array_min(ids) == original_size) & (F.array_max(ids) == vocab_size - 1) & (F.size(F.array_distinct(ids)) == F.size(ids))
