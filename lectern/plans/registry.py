"""Collects the registered queries and their SQL from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search", "structure", "recognise", "corpus", "text", "service", "streams")

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"lectern.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"lectern.plans.{name}").ORACLE
    return found
