"""Queries register here with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; without ``sql`` the query has no SQL equivalent."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return wrap


#: A table of fewer files than cores is dealt over the cores before work on it, if a core's share is at most this.
SMALL_SHARE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it comes from fewer files and is small; a table of one row group would be one task.

    What this moves is bounded by ``SMALL_SHARE`` a core; larger tables have splits enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_SHARE * cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
