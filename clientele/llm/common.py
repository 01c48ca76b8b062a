"""What several operators share: worker set-up, column helpers, ordered running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clientele.session import ship_package, shared_folder, stage

__all__ = ["read_table", "ready", "stage", "shared_folder", "fresh", "ordered_totals", "sized",
           "ASCII_SPACES", "ascii_lower", "split_words"]

#: Rows of a few numbers that may be sent to every executor, some 16 MB; above it a join shuffles.
BROADCAST_ROWS = 500_000

#: The white space of the word and line rules, and the letters they lower-case.
ASCII_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ready(spark: SparkSession) -> SparkSession:
    """Make the package known to the worker processes."""
    ship_package(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(prefix: str, taken: Iterable[str]) -> str:
    """A column name that no column has, whatever its case."""
    used = {c.lower() for c in taken}
    name = prefix
    while name.lower() in used:
        name = f"{prefix}_{uuid.uuid4().hex[:8]}"
    return name


def sized(table: DataFrame) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if its counted rows are at most BROADCAST_ROWS."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def split_words(c: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null gives no word."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def ordered_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                   name: str = "ordered") -> DataFrame:
    """``df`` with running totals, before each row, over one global order.

    ``sums`` maps new columns to what they add up (long or double). The rows are cut into ordered
    ranges and written once; only one row per range is summed in order, so no task sees more than a
    range. The order should be total: equal rows may come in any order.
    """
    pid = fresh("_range", df.columns)
    keys = [fresh(f"_order{i}", df.columns) for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order)))
    ranged = ranged.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys])
    ranged = stage(ranged.withColumn(pid, F.spark_partition_id()), name)
    totals = ranged.groupBy(pid).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    over = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = totals.select(pid, *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_{pid}") for k in sums])
    inside = (Window.partitionBy(pid).orderBy(*[F.col(k).asc_nulls_last() for k in keys])
              .rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.join(F.broadcast(before), pid)
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"{k}_{pid}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop(pid, *keys, *[f"{k}_{pid}" for k in sums])
