"""Spoken text over Arrow batches: one pass, or all passes fused in one Python step."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import english, finnish
from weftline.operators.text import mapped

#: The languages that have a normalizer.
LANGUAGES = {"en": english, "fi": finnish}


class UnsupportedLanguage(ValueError):
    """There is no normalizer for this language."""


def normalizer(lang: str):
    found = LANGUAGES.get(lang.lower())
    if found is None:
        raise UnsupportedLanguage(f"no normalizer for {lang!r}; there are {sorted(LANGUAGES)}")
    return found


def spoken(text: Column, lang: str, **options: bool) -> Column:
    """All passes of a language, in their order, over each text; null stays null."""
    return mapped(partial(normalizer(lang).normalize, **options), T.StringType())(text)


def one_pass(text: Column, lang: str, name: str) -> Column:
    return mapped(partial(normalizer(lang).run_pass, name), T.StringType())(text)


def by_language(text: Column, lang: Column) -> Column:
    """Each text by its own language's normalizer; texts of other languages are left as they are."""
    out = text
    for code in LANGUAGES:
        out = F.when(F.lower(lang) == code, spoken(F.when(F.lower(lang) == code, text), code)).otherwise(out)
    return out
