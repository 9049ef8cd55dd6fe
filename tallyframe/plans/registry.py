"""Named query registry.

Each entry binds a query name to a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the operation is expressible in SQL, an independent DuckDB oracle statement over
the driver's tables (ledger tables are provided as CTEs of the same bindings).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from tallyframe.plans import queries  # noqa: F401
    return REGISTRY
