"""The registered queries and, where SQL can say the same, their check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import code, columns, exchange, features, rollups

_FAMILIES = (columns, rollups, code, exchange, features)
Query = Callable[[SparkSession, str], DataFrame]


def _tuned(query: Query) -> Query:
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _tuned(query) for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
