"""Database scans and sinks over JDBC, and catalog listings.

Address and credentials always come from the caller; nothing is stored here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, driver: str | None = None, user: str | None = None,
                 password: str | None = None, **more: str) -> dict[str, str]:
    given = {"url": url, "driver": driver, "user": user, "password": password, **more}
    return {k: str(v) for k, v in given.items() if v is not None}


def read_options(options: dict[str, str], table: str | None = None, query: str | None = None,
                 split_on: str | None = None, bounds: tuple[int, int] | None = None,
                 splits: int = 16, fetch: int = 10_000) -> dict[str, str]:
    """Options of a scan: a query runs as one read, a table can be read in ``splits`` ranges."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    out = {**options, "fetchsize": str(fetch)}
    if query is not None:
        if split_on:
            raise ValueError("a query cannot be split; give it as a table: '(select …) t'")
        return {**out, "query": query}
    out["dbtable"] = table
    if split_on:
        low, high = bounds if bounds else (None, None)
        if low is None:
            raise ValueError("a split read needs the bounds of its column")
        out |= {"partitionColumn": split_on, "lowerBound": str(low), "upperBound": str(high),
                "numPartitions": str(splits)}
    return out


def read_jdbc(spark: SparkSession, options: dict[str, str], **kw) -> DataFrame:
    """A table or query; filters, column choice and LIMIT are pushed to the database."""
    return spark.read.format("jdbc").options(**read_options(options, **kw)).load()


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, replace: bool = True,
               connections: int = 16, batch: int = 10_000) -> None:
    """Write a table, at most ``connections`` tasks at a time."""
    (df.repartition(connections).write.format("jdbc")
     .options(**options, dbtable=table, batchsize=str(batch))
     .mode("overwrite" if replace else "append").save())


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{database}`" if database else "SHOW TABLES")
