"""Text functions for SQL, and a registry of named backends (transcribers, embedders, readers) that a user can extend."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import english, finnish
from weftline.functions.sentences import chunk_text, split_sentences
from weftline.sources.books import read_html

#: SQL name -> (Python function of one text, type of its result)
FUNCTIONS: dict[str, tuple[Callable[[str], object], T.DataType]] = {
    "spoken_en": (english.normalize, T.StringType()),
    "spoken_fi": (finnish.normalize, T.StringType()),
    "sentences": (split_sentences, T.ArrayType(T.StringType())),
    "text_chunks": (chunk_text, T.ArrayType(T.StringType())),
    "html_text": (lambda x: read_html(x)[0], T.StringType()),
}


def _batched(f: Callable[[str], object], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """Make the text functions known to ``spark.sql``, as Arrow-batched functions; returns their names."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, _batched(f, kind))
    return sorted(FUNCTIONS)


class Backends:
    """Named functions from a table of inputs to a table of results, in the order in which they were added."""

    def __init__(self) -> None:
        self._by_name: dict[str, tuple[Callable[[DataFrame], DataFrame], frozenset[str]]] = {}

    def add(self, name: str, f: Callable[[DataFrame], DataFrame], languages: tuple[str, ...] = ()) -> None:
        if not name or name in self._by_name:
            raise ValueError(f"a backend needs a name of its own: {name!r}")
        self._by_name[name] = (f, frozenset(languages))

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self._by_name:
            raise KeyError(f"no backend {name!r}; there are {list(self._by_name)}")
        return self._by_name[name][0]

    def names(self, language: str | None = None) -> list[str]:
        return [n for n, (_, langs) in self._by_name.items() if language is None or language in langs]
