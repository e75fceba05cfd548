"""Queries over the views and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Views of one folder by attribute: ``t.vox``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` as ``name``; ``sql`` may use the views named."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(tuple(views.split()), sql)
        return f

    return add


def draw_sql(seed: int, *keys: str) -> str:
    """The oracle's form of ``project.draw`` for keys that are not negative."""
    h = f"CAST({seed % 1_000_003} AS BIGINT)"
    for k in keys:
        h = f"(({h} * 48271 + (CAST({k} AS BIGINT) % 1000003) * 69621 + 12345) % 2147483647)"
    h = f"({h} % 1000003)"
    square = f"({h} * {h} % 1000003)"
    return f"((({square} * {square} % 1000003 * {h} % 1000003) * 48271 + 11) % 1000003 / CAST(1000003 AS DOUBLE))"
