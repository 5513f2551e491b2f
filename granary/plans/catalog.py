"""Collects every module's queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "m1_query_rate"
MODULES = ("mining", "relational", "scalars", "similarity", "rules", "streams", "resolution", "domain", "claims", "documents", "sinks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; a name that two modules use is an error."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        own = import_module(f"granary.plans.{m}").plans.queries
        if twice := found.keys() & own.keys():
            raise ValueError(f"queries of two modules: {sorted(twice)}")
        found |= own
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"granary.plans.{m}").plans.sql.items()}
