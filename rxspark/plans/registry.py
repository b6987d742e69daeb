"""Registry of runnable queries and, next to each, the equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rxspark.sources.clinical_views import table, view, with_views


@dataclass
class Inputs:
    """The test tables and the clinical views over them."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, make: Callable[[Inputs], DataFrame], views: list[str] | None = None, sql: str | None = None) -> None:
    """``sql`` follows a WITH clause of ``views``; it may start with further CTEs after a comma."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_views(views, sql) if views else sql


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    def wrap(make: Callable[[Inputs], DataFrame]):
        register(name, make, views, sql)
        return make

    return wrap
