"""All queries of the core, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["integrity", "graphs", "descriptors", "poses"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in import_module(f"trackweave.plans.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in import_module(f"trackweave.plans.{module}").ORACLE.items()}
