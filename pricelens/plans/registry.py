"""Registry of named queries: a Spark builder plus, where the operator is
expressible in SQL, the DuckDB oracle text with identical column names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    covers: tuple[str, ...]   # SURVEY §2 operator ids exercised
    headline: bool = False    # part of bench.py


_REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None,
             covers: tuple[str, ...] = (), headline: bool = False):
    def deco(fn: Builder) -> Builder:
        text = oracle() if callable(oracle) else oracle
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, text, tuple(covers), headline)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_REGISTRY)


def _load() -> None:
    # Importing the plan modules registers their queries.
    from pricelens.plans import trends, cleaning, franchise, matching, ingest, documents, learning, forecast, index  # noqa: F401
    from pricelens.plans import cases, features, merged, model  # noqa: F401
