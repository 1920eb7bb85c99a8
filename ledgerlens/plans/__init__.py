"""Complete queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["supply", "holders", "registry", "payments", "scopes", "transactions", "scalars"]


def catalogue() -> dict[str, tuple[Query, str | None]]:
    """Every query by name, with its SQL or None."""
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        for name, entry in import_module(f"ledgerlens.plans.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = entry
    return found
