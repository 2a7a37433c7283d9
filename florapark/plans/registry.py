"""Name to (Spark query, check SQL) registry filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from florapark.plans.inputs import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, views: str = ""):
    """Register ``fn(inputs)``; ``check`` may use the derived views named in ``views``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(views.split(), check)
        return fn

    return register
