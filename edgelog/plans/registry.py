"""Registry of query keys -> (Spark callable, DuckDB oracle text)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "edgelog.plans.q_log",
    "edgelog.plans.q_layout",
    "edgelog.plans.q_late",
    "edgelog.plans.q_metrics",
    "edgelog.plans.q_rules",
    "edgelog.plans.q_events",
    "edgelog.plans.q_logs",
    "edgelog.plans.q_streaming",
)


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
