"""Dictionary compression and its inverse.

Patterns are replaced longest first, each everywhere before the next, by a mark that no later pattern
can match; marks become macros, then templates apply, longest first. Over many documents the cascade
runs in Arrow batches, and an Aho-Corasick pass (where the library is there) tells which patterns a
text holds at all: one that it lacks cannot match later, since marks hold a character that patterns
lack. ``compress_native`` writes the same cascade as built-in expressions for small dictionaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import MAX_MACROS
from tessellon.session import ship

try:
    import ahocorasick
except ImportError:  # the search for present patterns is then one by one
    ahocorasick = None

IDENT = r"[A-Za-z_]\w*"
_SLOT = re.compile(r"\{(\d+)\}")
_MARKED = re.compile("\x00M(\\d+)\x00")
_EXACT, _SLOTTED = re.compile(r"<\|M(\d+)\|>"), re.compile(r"<\|T(\d+):([^|]*)\|>")


def template_regex(template: str, ident: str = IDENT) -> str | None:
    """An expression for a template: an identifier at a slot's first place, the same text at later
    ones. None if the slots do not come in order 0, 1, 2...: their arguments could not be read back."""
    out, seen = [], 0
    for i, piece in enumerate(_SLOT.split(template)):
        if i % 2 == 0:
            out.append(re.escape(piece))
        elif int(piece) < seen:
            out.append(f"(?P=s{piece})")
        elif int(piece) == seen:
            out.append(f"(?P<s{piece}>{ident})")
            seen += 1
        else:
            return None
    return "".join(out) if seen else None


class Codec:
    """A dictionary compiled once for each worker."""

    def __init__(self, rows: list[tuple[str, str, str]], ident: str = IDENT):
        """rows: kind, content, macro."""
        exact = sorted(((c, m) for k, c, m in rows if k == "M"), key=lambda r: (-len(r[0]), r[0]))
        slotted = sorted(((c, m) for k, c, m in rows if k == "T"), key=lambda r: (-len(r[0]), r[0]))
        self.exact = [(c, "\x00M" + m[3:-2] + "\x00") for c, m in exact if c]
        self.slotted = [(re.compile(x), m) for c, m in slotted if (x := template_regex(c, ident))]
        self.by_macro = {m: c for _, c, m in rows}
        self.automaton = None
        if ahocorasick and self.exact:
            self.automaton = ahocorasick.Automaton()
            for i, (c, _) in enumerate(self.exact):
                self.automaton.add_word(c, i)
            self.automaton.make_automaton()

    def _present(self, text: str) -> list[int]:
        if self.automaton is None:
            return [i for i, (c, _) in enumerate(self.exact) if c in text]
        return sorted({i for _, i in self.automaton.iter(text)})

    def compress(self, text: str) -> str:
        for i in self._present(text):
            text = text.replace(*self.exact[i])
        text = _MARKED.sub(r"<|M\1|>", text)
        for regex, macro in self.slotted:
            text = regex.sub(lambda m, macro=macro: f"{macro[:-2]}:{','.join(m.groups())}|>", text)
        return text

    def compress_zones(self, text: str, zones) -> str:
        """Compresses within the (start, end) ranges only; with none, nothing; ``None``: everywhere."""
        if zones is None:
            return self.compress(text)
        out, at = [], 0
        for start, end in zones:
            out += [text[at:start], self.compress(text[start:end])]
            at = end
        return "".join([*out, text[at:]])

    def decompress(self, text: str) -> str:
        """One pass over template macros, then one over exact ones; unknown macros stay."""

        def fill(m):
            template = self.by_macro.get(f"<|T{m[1]}|>")
            if template is None:
                return m[0]
            for i, arg in enumerate(m[2].split(",")):
                template = template.replace(f"{{{i}}}", arg)
            return template

        return _EXACT.sub(lambda m: self.by_macro.get(m[0], m[0]), _SLOTTED.sub(fill, text))


def _codec(dictionary: DataFrame, ident: str = IDENT):
    """Broadcast of the compiled rows; a dictionary holds 2 * MAX_MACROS rows at most."""
    rows = dictionary.select("kind", "content", "macro").limit(2 * MAX_MACROS + 1).toArrow().to_pylist()
    if len(rows) > 2 * MAX_MACROS:
        raise ValueError("dictionary too large")
    return dictionary.sparkSession.sparkContext.broadcast(([(r["kind"], r["content"], r["macro"]) for r in rows], ident))


def compressor(dictionary: DataFrame, ident: str = IDENT, zones: bool = False):
    """A column function text -> compressed text; with ``zones``, (text, array of ranges)."""
    ship(dictionary.sparkSession)
    shared = _codec(dictionary, ident)

    if zones:

        @F.pandas_udf("string")
        def zoned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            codec = Codec(*shared.value)
            for text, ranges in batches:
                yield pd.Series([None if t is None else codec.compress_zones(t, None if z is None else [(r["start"], r["end"]) for r in z]) for t, z in zip(text, ranges, strict=True)], dtype=object)

        return zoned

    @F.pandas_udf("string")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*shared.value)
        for text in batches:
            yield pd.Series([None if t is None else codec.compress(t) for t in text], dtype=object)

    return whole


def decompressor(dictionary: DataFrame):
    """A column function compressed text -> text."""
    ship(dictionary.sparkSession)
    shared = _codec(dictionary)

    @F.pandas_udf("string")
    def expand(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*shared.value)
        for text in batches:
            yield pd.Series([None if t is None else codec.decompress(t) for t in text], dtype=object)

    return expand


def compress_native(text: Column, patterns: list[tuple[str, str]], templates: list[tuple[str, str]] = ()) -> Column:
    """The cascade as expressions, for (content, macro) lists of some dozens."""
    for content, macro in sorted(patterns, key=lambda r: (-len(r[0]), r[0])):
        text = F.replace(text, F.lit(content), F.lit("\x00M" + macro[3:-2] + "\x00"))
    text = F.regexp_replace(text, "\x00M(\\d+)\x00", "<|M$1|>")
    for content, macro in sorted(templates, key=lambda r: (-len(r[0]), r[0])):
        regex = template_regex(content)
        if regex:
            java = re.sub(r"\(\?P=(s\d+)\)", r"\\k<\1>", regex.replace("(?P<", "(?<"))
            slots = sorted(set(re.findall(r"\?<(s\d+)>", java)), key=lambda s: int(s[1:]))
            text = F.regexp_replace(text, java, macro[:-2].replace("$", r"\$") + ":" + ",".join("${" + s + "}" for s in slots) + "|>")
    return text


def pattern_counts(text: Column, patterns: list[str]) -> Column:
    """Map of pattern -> times that it occurs in the text without overlaps, each on its own; those
    that occur."""
    n = [(F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / F.lit(len(p)) for p in patterns]
    found = F.map_from_arrays(F.array(*map(F.lit, patterns)), F.array(*[c.cast("int") for c in n]))
    return F.map_filter(found, lambda _, v: v > 0)


def compression_stats(original: Column, compressed: Column) -> Column:
    a, b = F.length(original), F.length(compressed)
    return F.struct(a.alias("original_chars"), b.alias("compressed_chars"), (a - b).alias("saved_chars"), F.when(a > 0, 100.0 * (a - b) / a).otherwise(0.0).alias("reduction_pct"))
