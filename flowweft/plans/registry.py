"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _session(spark: SparkSession) -> SparkSession:
    """The queries compare days with SQL that reads them in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return configure(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``f(spark, sf_dir)`` under ``name``."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(_session(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return add
