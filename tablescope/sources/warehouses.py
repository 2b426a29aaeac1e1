"""One reader for catalog tables, parquet folders and the supported warehouses (over JDBC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: JDBC url prefix and driver class per warehouse; the jars are the user's own
JDBC = {
    "athena": ("jdbc:athena://", "com.amazon.athena.jdbc.AthenaDriver"),
    "bigquery": ("jdbc:bigquery://", "com.simba.googlebigquery.jdbc.Driver"),
    "clickhouse": ("jdbc:clickhouse://", "com.clickhouse.jdbc.ClickHouseDriver"),
    "databricks": ("jdbc:databricks://", "com.databricks.client.jdbc.Driver"),
    "duckdb": ("jdbc:duckdb:", "org.duckdb.DuckDBDriver"),
    "fabric": ("jdbc:sqlserver://", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "motherduck": ("jdbc:duckdb:md:", "org.duckdb.DuckDBDriver"),
    "mssql": ("jdbc:sqlserver://", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "postgres": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift://", "com.amazon.redshift.Driver"),
    "snowflake": ("jdbc:snowflake://", "net.snowflake.client.jdbc.SnowflakeDriver"),
    "starrocks": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "trino": ("jdbc:trino://", "io.trino.jdbc.TrinoDriver"),
}


def jdbc_options(kind: str, address: str, table: str | None = None, sql: str | None = None,
                 partition: tuple[str, object, object, int] | None = None, **extra: str) -> dict[str, str]:
    """Options of a JDBC read.

    ``partition`` is (column, lower, upper, parts): without it a whole table comes through one
    connection, so large tables must name one. Spark pushes filters, projections and limits down.
    """
    if (table is None) == (sql is None):
        raise ValueError("name either a table or a query")
    prefix, driver = JDBC[kind]
    # a partitioned read needs dbtable, so a query becomes a derived table
    options = {"url": prefix + address, "driver": driver, "dbtable": table or f"({sql}) q", "fetchsize": "10000", **extra}
    if partition:
        column, low, high, parts = partition
        options |= {
            "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)
        }
    return options


def read_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """``table`` and ``parquet`` read inside Spark; every other kind is a warehouse."""
    if kind == "table":
        return spark.table(options["table"])
    if kind == "parquet":
        return spark.read.parquet(options["path"])
    return spark.read.format("jdbc").options(**jdbc_options(kind, **options)).load()


def run_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """A SQL string with named parameters; nothing is pasted into the text."""
    return spark.sql(sql, args=args or {})


# fixed values: most log rows a sync of each warehouse asks for, for callers that want a limit
LOG_LIMITS = {"bigquery": 50_000}
DEFAULT_LOG_LIMIT = 10_000


def query_log(log: DataFrame, kind: str, as_of: Column, days: int, limit: int | None = None) -> DataFrame:
    """Recent finished queries; with a ``limit`` the newest ones, and ``truncated`` says whether there are more.

    ``log``: query_text, query_type, status, started_at. Postgres keeps no times or types; Redshift keeps
    any query that did not abort.
    """
    if kind != "postgres":
        log = log.filter(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(days)))
        if kind == "redshift":
            log = log.filter(F.col("status") != "aborted")
        else:
            log = log.filter((F.col("query_type") == "SELECT") & (F.col("status") == "success"))
    if limit is None:
        return log.withColumn("truncated", F.lit(False))
    newest = log.orderBy(F.col("started_at").desc(), F.col("query_text").asc()).limit(limit)
    return newest.withColumn("truncated", log.agg(F.count(F.lit(1)) > limit).scalar())
