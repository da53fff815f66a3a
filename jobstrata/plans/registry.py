"""All registered queries, in the order of the operator inventory."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("q_market", "q_funnel", "q_matching", "q_monitor", "q_sources", "q_streaming")


def query(name: str, sql: str | None = None):
    """Registers a query under its inventory id; `sql` is the equivalent over the same tables."""
    def wrap(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return wrap


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"jobstrata.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
