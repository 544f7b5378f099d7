"""All registered queries of the engine with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, duckdb_sql

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ["scalars", "statistics", "matching", "validation", "spectra", "ranking", "graphs", "text_sources", "incremental"]


def query(name: str, oracle: str | None = None):
    """Register a function of Views as query ``name``, with DuckDB SQL that names views in braces."""

    def register(build: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if oracle:
            _ORACLES[name] = duckdb_sql(oracle)
        return build

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"resonara.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, build=build: build(Views(spark, sf_dir))) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
