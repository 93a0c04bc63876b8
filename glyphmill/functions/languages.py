"""Source languages by id: what needs translation, and what must not remain of it. register() adds others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from glyphmill.functions import text as T


@dataclass(frozen=True)
class Language:
    """needs: whether a text holds words of the language. residual (source, target, allowed terms): what the target kept of it, or null."""

    id: str
    needs: Callable[[Column], Column]
    residual: Callable[[Column, Column, list[str]], Column]


LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> None:
    if language.id in LANGUAGES:
        raise ValueError(f"language {language.id} is registered")
    LANGUAGES[language.id] = language


def language(tag: str) -> Language:
    """By the tag or, failing that, by its primary part."""
    found = LANGUAGES.get(tag) or LANGUAGES.get(tag.replace("_", "-").split("-")[0].lower())
    if found is None:
        raise KeyError(f"no language {tag}")
    return found


register(Language("ja", T.needs_japanese, lambda source, target, allowed: T.kana_residual(target, allowed, 2)))
register(Language("en", T.needs_english, lambda source, target, allowed: T.copied_fragment(source, target, 4)))
