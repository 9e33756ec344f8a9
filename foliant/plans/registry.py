"""All queries of the engine by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import bundle, catalog, metadata, operations, storage, streams, text

_PLANS = (catalog, text, metadata, operations, bundle, streams, storage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reduce(lambda a, b: a | b.QUERIES, _PLANS, {})


def oracle_sql() -> dict[str, str]:
    return reduce(lambda a, b: a | b.ORACLE_SQL, _PLANS, {})
