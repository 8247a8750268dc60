"""Every registered query of the engine, by family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from marquee.plans.fixtures import Data, with_views

FAMILIES = ("behaviour", "warehouse", "relational", "retrieval", "querylog", "ranking", "people", "quality", "causal", "graphs", "health", "streams", "serving", "vectors", "content")


def families() -> dict[str, tuple[Callable[[Data], DataFrame], str | None]]:
    """name to (query over the data, SQL or None)."""
    found: dict[str, tuple[Callable[[Data], DataFrame], str | None]] = {}
    for family in FAMILIES:
        found |= import_module(f"marquee.plans.{family}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, q=query: q(Data(spark, folder))) for name, (query, _) in families().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in families().items() if sql}
