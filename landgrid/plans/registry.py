"""All reference-operator queries by name, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landgrid.fixtures import fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None) -> Callable:
    """Register ``f(*fixtures) -> DataFrame`` as query ``name`` over the named fixture views, with its DuckDB SQL."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, v) for v in views.split()])
        if sql is not None:
            ORACLE[name] = oracle(views, sql)
        return f

    return wrap


def load() -> None:
    """Import the modules that register queries."""
    from landgrid.plans import evaluate, extra, partitions, raster, stores, survey, tiles, vector  # noqa: F401


