"""CSV and Parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clientele.functions.scalars import parse_ts

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Part files with a header and timestamps in ISO form. Empty text comes back as NULL."""
    out = df.withColumns({
        f.name: F.col(f.name).cast("string") for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))})
    out.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a header CSV in the given schema: no inference pass over the data."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType)
                      else f.dataType) for f in schema])
    raw = spark.read.schema(as_text).option("header", True).csv(path)
    return raw.withColumns({f.name: parse_ts(f.name) for f in schema
                            if isinstance(f.dataType, T.TimestampNTZType)}).select(schema.names)


def load_lines(spark: SparkSession, path: str, schema: T.StructType | str,
               names: dict[str, str]) -> DataFrame:
    """Order lines from CSV, with the file's columns renamed to the canonical names."""
    return read_csv(spark, path, schema).withColumnsRenamed(names)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path
