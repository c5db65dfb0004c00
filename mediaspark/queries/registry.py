"""Registry of named queries: a Spark callable and, where it can be said in
SQL, the statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaspark.views import Views

Build = Callable[[Views], DataFrame]
_BUILDERS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return add


def _runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Views(spark, folder))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(build) for name, build in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from mediaspark.queries import (  # noqa: F401
        assignment,
        catalogs,
        filters,
        library,
        projects,
        search,
        timing,
    )
