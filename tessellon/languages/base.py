"""What the engine knows about a programming language, as data."""

from __future__ import annotations

import keyword
import builtins
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """A language: how to find what must not be rewritten, and what is boilerplate.

    ``comments`` and ``strings`` are expressions for what a scanner skips, in order of preference;
    ``is_safe`` says which comments and strings are documentation, and may be rewritten after all.
    ``structural`` names are never slots of a template. ``repos`` and ``eval_repos`` are a corpus's
    configuration, and come from the caller.
    """

    name: str
    extension: str
    comments: tuple[str, ...]
    strings: tuple[str, ...]
    candidates: tuple[str, ...]
    seeds: tuple[tuple[str, str], ...]
    structural: frozenset[str]
    is_safe: Callable[[str, str, int], bool] | None = None  # (token, text, start)
    extensions: tuple[str, ...] = ()
    ident: str = r"[a-zA-Z_]\w*"
    min_depth: int = 2  # of a statement that can be a template; text without any nesting has 1
    type_first: bool = True  # ``Type name``: of two identifiers in a row the first is a type
    skip_paths: tuple[str, ...] = ("/test/fixtures/", "/vendor/", "/node_modules/", "/generated/", "/third_party/", "/.git/", "/dist/")
    repos: tuple[str, ...] = field(default=())
    eval_repos: tuple[str, ...] = field(default=())

    @property
    def source_extensions(self) -> tuple[str, ...]:
        return self.extensions or (self.extension,)


def python_names() -> frozenset[str]:
    """Keywords and built-in names, from the interpreter itself."""
    return frozenset(keyword.kwlist) | frozenset(keyword.softkwlist) | frozenset(n for n in dir(builtins) if not n.startswith("__")) | {"self", "cls", "__init__", "__name__"}


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())
