"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import adapters, changes, market, pages, rules

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (market, changes, pages, rules, adapters)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
