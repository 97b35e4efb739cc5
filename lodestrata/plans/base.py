"""Registry of named queries, their SQL twins, and the table views they share.

A view is SQL text that both engines read. ``<<name>>`` stands for one of the
given tables or for another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the scan has fewer splits than there are (one small file, say).

    A table of many files has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _expand(sql: str, name_table: Callable[[str], str]) -> str:
    def put(m):
        name = m.group(1)
        return f"({_expand(VIEWS[name], name_table)})" if name in VIEWS else name_table(name)
    return re.sub(r"<<(\w+)>>", put, sql)


def view(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    """A shared view as a DataFrame over the given tables; ``parallel`` spreads the rows it is built from."""
    if not parallel:
        return spark.sql(_expand(VIEWS[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    def spread_view(t: str) -> str:
        spread(table(spark, sf_dir, t)).createOrReplaceTempView(f"spread_{t}")
        return f"spread_{t}"

    return spark.sql(_expand(VIEWS[name], spread_view))


def duck(sql: str) -> str:
    """SQL text of a twin with the views put in."""
    return _expand(sql, lambda t: t)


def query(name: str, oracle: str | None = None):
    """Register a query; the SQL twin may use ``<<view>>``."""
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return fn
    return put
