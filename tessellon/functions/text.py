"""Scalar text expressions: all built-in, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the default counter: letter runs, single digits, runs of other marks, runs of blanks.
TOKEN = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9 \t\r\n]+|[ \t\r\n]+"
# Limits of mining.
MIN_CHARS, MIN_TOKEN_SPAN, MIN_FREQUENCY, MIN_REPOS = 8, 3, 50, 2
MAX_BLANK_SHARE = 0.5
MACRO_RE = r"<\|[MT]\d+(?::[^|]*)?\|>"
MAX_MACROS = 99_999


def token_count(text: Column) -> Column:
    """How many tokens the default counter sees. Null counts as 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0))


def has_tokens(text: Column, n: int) -> Column:
    """Whether ``token_count`` is ``n`` at least; only so many tokens are looked at. Null has none, and is never enough."""
    return text.rlike(rf"\A(?:{TOKEN.replace('+', '++')}){{{n}}}") if n > 0 else text.isNotNull()


def strip(text: Column) -> Column:
    """Without the white space around it, by one explicit class on every engine."""
    return F.btrim(text, F.lit(" \t\r"))


def strip_unicode(text: Column) -> Column:
    """As ``strip`` for any Unicode white space, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_single_word(text: Column) -> Column:
    return text.rlike(r"(?U)^\w+$")


def is_valid_pattern(text: Column) -> Column:
    """No line ends, at least eight characters, not blank, more than one word."""
    return ~text.rlike(r"[\r\n]") & (F.length(text) >= MIN_CHARS) & text.rlike(r"(?U)\S") & ~is_single_word(text)


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " \t", ""))


def is_valid_ngram(text: Column) -> Column:
    """A valid pattern of which blanks make up half at most."""
    return is_valid_pattern(text) & (blanks(text) <= MAX_BLANK_SHARE * F.length(text))


def is_word_boundary_start(text: Column, pos: Column) -> Column:
    """Whether a word may start at 0-based ``pos``: only the character outside is looked at."""
    return (pos <= 0) | ~F.substring(text, pos, F.lit(1)).rlike("[A-Za-z0-9_]")


def is_word_boundary_end(text: Column, pos: Column) -> Column:
    """Whether a word may end before 0-based ``pos``."""
    return (pos >= F.length(text)) | ~F.substring(text, pos + 1, F.lit(1)).rlike("[A-Za-z0-9_]")


def macro_token(kind: str, number: Column) -> Column:
    return F.format_string(f"<|{kind}%05d|>", number.cast("int"))


def slot_count(template: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\d+)\}"), F.lit(1))))


def expand_template(template: Column, args: Column, most: int = 6) -> Column:
    """The template with its slots filled from an array, in order of their numbers."""
    out = template
    for i in range(most):
        out = F.when(F.size(args) > i, F.replace(out, F.lit(f"{{{i}}}"), F.coalesce(F.get(args, i), F.lit("")))).otherwise(out)
    return out


def contains_macros(text: Column) -> Column:
    return text.rlike(MACRO_RE)


def list_macros(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MACRO_RE), F.lit(0))


def eval_repo_key(repo: Column) -> Column:
    """One spelling of ``owner--repo`` and ``owner/repo``."""
    return F.replace(repo, F.lit("--"), F.lit("/"))


def keep_by_hash(key: Column, ratio: float, seed: int = 42) -> Column:
    """A Bernoulli choice that any engine makes alike: the first 32 bits of md5(key || seed)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") < int(ratio * 2**32)


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))).cast("binary"))
