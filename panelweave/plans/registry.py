"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.columns import rounded
from panelweave.plans.fixtures import Fixtures
from panelweave.plans.oracle import wrap

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BUILDS: dict[str, Callable[[Fixtures], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Fixtures], DataFrame], sql: str | None = None) -> None:
    _BUILDS[name] = build
    _QUERIES[name] = lambda spark, sf_dir: rounded(build(Fixtures.of(spark, sf_dir)))
    if sql:
        _ORACLE[name] = wrap(sql)


def add_fold(name: str, build: Callable[[Fixtures], DataFrame], sql: str) -> None:
    """wrap() puts the fixtures in front, so RECURSIVE moves to the front too."""
    add(name, build, sql)
    _ORACLE[name] = _ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


def alias(name: str, other: str) -> None:
    """name's rows are those of another query's SQL."""
    _ORACLE[name] = _ORACLE[other]


def over(name: str, fixtures: Fixtures) -> DataFrame:
    """A registered query over other fixtures than the tables' nations."""
    return rounded(_BUILDS[name](fixtures))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
