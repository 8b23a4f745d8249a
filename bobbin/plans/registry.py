"""Registered queries: name, function over the views, and DuckDB text over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register `f(*input DataFrames)` as a query; `sql` is its DuckDB twin."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in inputs))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
