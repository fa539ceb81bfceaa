"""The catalogue of queries over the operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from kgspark.plans import context, knowledge, lifecycle, search

Query = Callable[[SparkSession, str], DataFrame]
AREAS: tuple[ModuleType, ...] = (search, knowledge, context, lifecycle)


def queries() -> dict[str, Query]:
    return {f.__name__: f for area in AREAS for f in area.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
