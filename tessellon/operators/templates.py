"""Parameterised templates: boilerplate with identifiers as slots.

Without a parser for every language, an identifier's role is read from what stands around it. Names
that call, are called, construct, are members (but of ``this`` and ``self``) or name types stay; other
names become slots ``{0}``, ``{1}``, the same name the same slot. Candidates come from a language's
expressions, or from the statements of its bracket tree (``statements=True``), by their depth.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import MIN_CHARS, MIN_REPOS, MIN_TOKEN_SPAN, expand_template, slot_count, token_count
from tessellon.languages import Language, get_language
from tessellon.operators.candidates import document_frequency, top
from tessellon.operators.lexer import safe_ranges
from tessellon.operators.tree import parse
from tessellon.session import materialise, ship

# Limits of templates.
MIN_FREQUENCY, MIN_SLOTS, MAX_SLOTS, MAX_SOURCE = 30, 1, 6, 200
MAX_DEPTH = 6
DEFAULT_PROXY = "_varName"
_OWN = re.compile(r"(?:this|self|cls)\s*(?:\.|\?\.|->)\s*$")


def should_normalize(text: str, start: int, end: int, language: Language) -> bool:
    """Whether the identifier at [start, end) is a slot."""
    if text[start:end] in language.structural:
        return False
    before, after = text[:start].rstrip(), text[end:].lstrip(" \t")
    if before.endswith((".", "->")) and not _OWN.search(text[:start]):
        return False
    if after.startswith(("(", "<", "::")) or before.endswith(("new", "@", "#", "class", "interface", "struct", "enum", "namespace", "package", "import", "using", "throw new")):
        return False
    if language.type_first and re.match(r"(?:\[\]|\?)?\s+[A-Za-z_$]", text[end:]) and not re.match(r"\s+(?:in|is|as|and|or|not|if|else|instanceof)\b", text[end:]):
        return False  # a type before the name that it declares
    if not language.type_first and re.search(r":\s*$", text[:start]) and text[start].isupper():
        return False  # a type behind the name
    return not (text[start].isupper() and after.startswith("."))


def normalize(text: str, language: Language, collapse: bool = False, names: set[int] | None = None) -> tuple[str, list[str]] | None:
    """(template, arguments), or None if there is nothing to normalise or nothing else left. ``names``:
    where identifiers start, if a tree tells; none stands in a string then."""
    slots: dict[str, int] = {}
    out, at = [], 0
    if _looks_slotted(text):
        return None
    for m in re.finditer(language.ident, text):
        if (names is not None and m.start() not in names) or (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_$")) or not should_normalize(text, *m.span(), language):
            continue
        n = slots.setdefault(m[0], len(slots))
        if n >= MAX_SLOTS:
            return None
        out += [text[at : m.start()], f"{{{n}}}"]
        at = m.end()
    if not slots:
        return None
    template = "".join([*out, text[at:]])
    if collapse:
        template = " ".join(template.split())
    letters = re.sub(r"[^a-zA-Z]", "", re.sub(r"\{\d+\}", "", template))
    return None if "}{" in template or len(letters) < 2 else (template, list(slots))


def _looks_slotted(text: str) -> bool:
    """Literal ``{0}`` in code cannot be told from a slot."""
    return re.search(r"\{\d+\}", text) is not None


def identifiers_in_range(text: str, start: int, end: int, language: Language) -> list[tuple[str, int, int, bool]]:
    """(name, start, end, whether it would be a slot) of the identifiers wholly inside [start, end)."""
    out = []
    for m in re.finditer(language.ident, text):
        if m.start() >= start and m.end() <= end and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_$")):
            out.append((m[0], *m.span(), should_normalize(text, *m.span(), language)))
    return out


def expression_candidates(text: str, language: Language) -> list[tuple[str, list[str]]]:
    out = []
    for start, end in safe_ranges(text, language):
        zone = text[start:end]
        for p in language.candidates:
            for m in re.finditer(p, zone):
                if len(m[0]) >= MIN_CHARS and (found := normalize(m[0], language)):
                    out.append(found)
    return out


def statement_candidates(text: str, language: Language) -> list[tuple[str, list[str]]]:
    """Statements of the file's tree, nested ones too, that start in a safe zone and are deep enough to
    have structure, but not so deep that they are whole functions."""
    starts, ends = zip(*safe_ranges(text, language), strict=True) if text else ((), ())
    out = []
    for node in parse(text, language).walk():
        if node.kind != "statement" or not MIN_CHARS <= node.end - node.start <= MAX_SOURCE:
            continue
        zone = bisect.bisect_right(starts, node.start) - 1
        if zone < 0 or node.start >= ends[zone] or not language.min_depth <= node.depth() <= MAX_DEPTH:
            continue
        names = {n.start - node.start for n in node.walk() if n.kind == "identifier"}
        if (found := normalize(text[node.start : node.end], language, collapse=True, names=names)) and len(found[0]) >= MIN_CHARS:
            out.append(found)
    return out


def template_uses(corpus: DataFrame, language: str | Language, statements: bool = False) -> DataFrame:
    """file_id, repo, template, args of every candidate."""
    ship(corpus.sparkSession)
    lang = get_language(language) if isinstance(language, str) else language
    find = statement_candidates if statements else expression_candidates

    @F.pandas_udf("array<struct<template:string,args:array<string>>>")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"template": t, "args": a} for t, a in find(x or "", lang)] for x in texts])

    return corpus.select("file_id", "repo", F.explode(extract("content")).alias("t")).select("file_id", "repo", "t.template", "t.args")


def template_census(uses: DataFrame) -> DataFrame:
    """template, frequency (files), repo_count."""
    once = uses.select("file_id", "repo", "template").distinct()
    return document_frequency(once, "template")


def identifier_census(uses: DataFrame) -> DataFrame:
    """ident, n, tokens: every argument of every use counts."""
    return uses.select(F.explode("args").alias("ident")).groupBy("ident").agg(F.count("*").alias("n")).withColumn("tokens", token_count(F.col("ident")))


def identifier_proxy(idents: DataFrame) -> DataFrame:
    """One row: the identifier whose cost is nearest to the weighted mean; ties by name."""
    mean = idents.agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("mean"))
    out = idents.join(F.broadcast(mean)).agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("mean")).alias("d"), F.col("ident"))).alias("m"), F.first("mean").alias("mean"))
    return out.select(F.coalesce("m.ident", F.lit(DEFAULT_PROXY)).alias("proxy"), F.coalesce("mean", F.lit(0.0)).alias("mean_tokens"))


def estimated_saving(template: Column, slots: Column, proxy: Column) -> Column:
    args = F.array_repeat(proxy, slots)
    return F.greatest(token_count(expand_template(template, args)) - 2 - token_count(F.array_join(args, ",")), F.lit(0))


def score_templates(census: DataFrame, proxy: DataFrame, min_frequency: int = MIN_FREQUENCY, min_repos: int = MIN_REPOS, min_slots: int = MIN_SLOTS, max_slots: int = MAX_SLOTS, min_tokens: int = 0) -> DataFrame:
    """template, frequency, slot_count, score, repo_count. ``min_tokens`` is for statements."""
    rows = census.where((F.col("frequency") >= min_frequency) & (F.col("repo_count") >= min_repos)).withColumn("slot_count", slot_count(F.col("template")))
    rows = rows.where(F.col("slot_count").between(min_slots, max_slots)).join(F.broadcast(proxy))
    if min_tokens:
        rows = rows.where(token_count(expand_template(F.col("template"), F.array_repeat("proxy", F.col("slot_count")))) >= min_tokens)
    score = F.col("frequency") * estimated_saving(F.col("template"), F.col("slot_count"), F.col("proxy"))
    return rows.select("template", "frequency", "slot_count", score.alias("score"), "repo_count")


def mine_templates(corpus: DataFrame, language: str | Language, top_n: int = 2000, statements: bool = False, **limits) -> DataFrame:
    uses = materialise(template_uses(corpus, language, statements), "uses")
    if statements:
        limits.setdefault("min_tokens", MIN_TOKEN_SPAN)
    return top(score_templates(template_census(uses), identifier_proxy(identifier_census(uses)), **limits), top_n, tie="template")
