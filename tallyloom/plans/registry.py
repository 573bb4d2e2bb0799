"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def over_star(name: str, sql: str | None = None):
    """Register a query of the review domain's tables; ``sql`` may name its views."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(star.load(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = star.sql(sql)
        return build

    return add


def over_files(name: str, sql: str | None = None):
    """Register a query of the driver's tables: ``build(spark, table)``, where table(name) reads one."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add
