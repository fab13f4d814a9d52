"""All registered queries of the library and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of reckoner.plans that hold QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("mapping", "chunking", "delivering", "accounts", "operations", "streams", "interchange", "reporting")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"reckoner.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"reckoner.plans.{m}").ORACLE_SQL.items()}
