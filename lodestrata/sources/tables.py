"""Relational scan and sink, SQL text, catalog listing, table profile."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcConf:
    """Connection settings of a relational store."""

    host: str
    database: str
    port: int = 5432
    user: str | None = None
    password: str | None = None
    ssl_mode: str | None = None
    vendor: str = "postgresql"
    driver: str | None = None
    fetch_size: int = 10_000
    extra: dict[str, str] = field(default_factory=dict)

    def url(self) -> str:
        base = f"jdbc:{self.vendor}://{self.host}:{self.port}/{self.database}"
        return f"{base}?sslmode={self.ssl_mode}" if self.ssl_mode else base

    def options(self) -> dict[str, str]:
        out = {"url": self.extra.get("url", self.url()), "fetchsize": str(self.fetch_size)}
        for name, value in (("user", self.user), ("password", self.password), ("driver", self.driver)):
            if value:
                out[name] = value
        return {**out, **self.extra}


def jdbc_options(conf: JdbcConf, table_or_query: str, partition: tuple[str, object, object, int] | None = None) -> dict[str, str]:
    """Reader options; ``partition`` is (column, lower, upper, partitions) for a parallel read."""
    out = conf.options()
    is_query = table_or_query.lstrip().lower().startswith(("select", "with"))
    if is_query and partition:
        # A partitioned read needs a table expression.
        out["dbtable"] = f"({table_or_query}) q"
    else:
        out["query" if is_query else "dbtable"] = table_or_query
    if partition:
        column, low, high, parts = partition
        out.update(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return out


def read_jdbc(spark: SparkSession, conf: JdbcConf, table_or_query: str,
              partition: tuple[str, object, object, int] | None = None) -> DataFrame:
    """Table or query rows; filters, columns and limits are pushed to the store by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(conf, table_or_query, partition)).load()


def write_jdbc(df: DataFrame, conf: JdbcConf, table: str, mode: str = "append", batch_size: int = 10_000) -> None:
    """Create the table or append rows, in batches, one connection per partition."""
    df.write.format("jdbc").options(**conf.options(), dbtable=table, batchsize=str(batch_size)).mode(mode).save()


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, count: bool = False, **tables: DataFrame) -> DataFrame:
    """Rows of SQL text with named parameters; with ``count`` each row carries ``row_count``."""
    rows = spark.sql(sql, args=args or {}, **tables)
    if not count:
        return rows
    return rows.withColumn("row_count", rows.agg(F.count(F.lit(1))).scalar())


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Tables and views of one schema or of all, by schema and name."""
    schemas = [schema] if schema else [d.name for d in spark.catalog.listDatabases()]
    rows = [(s, t.name, t.tableType, t.isTemporary) for s in schemas for t in spark.catalog.listTables(s)]
    return spark.createDataFrame(rows, "schema string, name string, type string, is_temporary boolean").orderBy("schema", "name")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, bytes of its JSON form, number of fields, first five field names."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("row_count"),
                      F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes")).select(
            F.lit(name).alias("table_name"), "row_count", "bytes", F.lit(len(df.columns)).alias("field_count"),
            F.lit(", ".join(df.columns[:5])).alias("sample_fields"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
