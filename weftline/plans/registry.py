"""All queries of the engine with their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES: tuple[str, ...] = ("projections", "speech", "texts", "stats", "normalizers", "logs", "files", "endtoend")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that has to give the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__module__ != f.__module__:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"weftline.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
