"""Language registry."""

from __future__ import annotations

from pathlib import Path

from tessellon.languages import csharp, go, java, python, typescript
from tessellon.languages.base import Language  # noqa: F401

_ALL = {m.LANGUAGE.name: m.LANGUAGE for m in (csharp, go, java, python, typescript)}


def register(language: Language) -> None:
    """Adds a language of the caller's."""
    _ALL[language.name] = language


def get_language(name: str) -> Language:
    try:
        return _ALL[name]
    except KeyError:
        raise ValueError(f"unknown language {name!r}; there are {', '.join(available_languages())}") from None


def available_languages() -> list[str]:
    return sorted(_ALL)


def dictionary_path(name: str, root: str) -> str | None:
    """A stored dictionary for the language under ``root``, if there is one."""
    get_language(name)
    path = Path(root) / name / "dictionary.json"
    return str(path) if path.exists() else None
