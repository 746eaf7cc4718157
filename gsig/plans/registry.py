"""Registered queries and their SQL. A module of plans registers a query with @query."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import adapters

MODULES = ("reads", "sequences", "windows", "intervals", "fragments", "tracks", "kmers", "stats", "sampling", "scoring", "files")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    """Access by name to the given tables and to the views that adapters derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        made = getattr(adapters, name, None)
        return made(self) if made else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers f(tables) under its name; sql may refer to the views of adapters, which are put before it."""

    def register(f):
        key = name or f.__name__
        _queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _sql[key] = adapters.with_views(sql)
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"gsig.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
