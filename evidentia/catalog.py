"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Put a query, and its SQL twin if it has one, into the catalogue."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rounds: int = 1) -> DataFrame:
    """df over at least as many partitions as the session runs tasks at once, or rounds times as many: a small file is one split, and what is read from it may be dear to work on."""
    n = rounds * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_methods(spark: SparkSession) -> None:
    """Has the session cut generated code at the size of a method that the JVM still compiles; many patterns in one projection would run interpreted."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
