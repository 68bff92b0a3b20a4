"""Registered queries: a name, a function over the given tables, and the same question in
SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .driver_views import BASE_TABLES, SPARK_VIEWS, VIEWS, spark_sql_text, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder and the views defined over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}
        self._wide: Tables | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._seen[name] = self.sql(SPARK_VIEWS[name])
        return self._seen[name]

    def spread(self, name: str) -> DataFrame:
        """A table about to be read with CPU-heavy text functions; a view is built over
        spread tables."""
        if name in BASE_TABLES:
            return spread(self[name])
        if self._wide is None:
            self._wide = Tables(self.spark, self.folder)
            self._wide._seen = {base: spread(self[base]) for base in ("orders", "lineitem")}
        return self._wide[name]

    def sql(self, text: str) -> DataFrame:
        used = [n for n in [*BASE_TABLES, *VIEWS] if "{" + n + "}" in text]
        return self.spark.sql(spark_sql_text(text), **{n: self[n] for n in used})


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)``; ``oracle`` may name views in braces."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
