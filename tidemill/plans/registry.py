"""All registered queries, by the identifiers of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "top5_hybrid_search"


def _parts() -> list:
    from importlib import import_module
    from pkgutil import iter_modules

    import tidemill.plans as here

    return [import_module(f"tidemill.plans.{m.name}") for m in iter_modules(here.__path__) if m.name.startswith("q_")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _parts() for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _parts() for k, s in part.SQL.items()}
