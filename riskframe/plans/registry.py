"""Registry of bound queries: name -> (spark builder, oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables (or data Spark derives from them). The oracle SQL runs in DuckDB
on the same tables; ``None`` marks jobs checked by rows only (ML fits,
streaming) with their own unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the plan modules fills the registry.
    from riskframe.plans import (  # noqa: F401
        dataset,
        evaluation,
        drift,
        profile,
        features,
        health,
        relational,
        checks,
        models,
        streaming,
        functions,
        io,
    )

    return REGISTRY
