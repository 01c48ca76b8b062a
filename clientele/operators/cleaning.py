"""Outlier limits, winsorising, outlier removal and the retail clean-up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.scalars import line_total, null_safe_not, safe_ratio
from clientele.operators.order_stats import exact_quantiles
from clientele.operators.profiling import _long

Limits = dict[str, tuple[float, float]]


def outlier_limits(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95,
                   reach: float = 1.5) -> Limits:
    """Per column (lower, upper) limit: the two quantiles, moved out by reach times their distance."""
    got = exact_quantiles(df, {c: (c, [low, high]) for c in columns})
    return {c: (a - reach * (b - a), b + reach * (b - a)) for c, (a, b) in got.items()
            if a is not None}


def _outside(column: str, limits: tuple[float, float]) -> Column:
    x = F.col(column).cast("double")
    return (x < F.lit(limits[0])) | (x > F.lit(limits[1]))


def limits_frame(df: DataFrame, limits: Limits) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(c, lo, hi) for c, (lo, hi) in limits.items()],
        "column string, low_limit double, up_limit double")


def winsorise(df: DataFrame, limits: Limits) -> DataFrame:
    """Pull values outside the limits to the limit; NULL stays NULL."""
    def pulled(c: str, lo: float, hi: float) -> Column:
        x = F.col(c).cast("double")
        return F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
    return df.withColumns({c: pulled(c, lo, hi) for c, (lo, hi) in limits.items()})


def has_outlier(df: DataFrame, limits: Limits) -> DataFrame:
    """(column, has_outlier) for every column, in one pass."""
    row = df.agg(*[F.coalesce(F.bool_or(_outside(c, l)), F.lit(False)).alias(f"o_{c}")
                   for c, l in limits.items()])
    return _long(row, {c: {"has_outlier": f"o_{c}"} for c in limits})


def remove_outliers(df: DataFrame, limits: Limits, mode: str = "all") -> DataFrame:
    """Rows inside the limits; a missing value is not outside.

    ``mode="all"`` checks every column, ``"last"`` only the last one.
    """
    columns = list(limits)[-1:] if mode == "last" else list(limits)
    masks = [null_safe_not(_outside(c, limits[c])) for c in columns]
    return df.where(reduce(lambda a, b: a & b, masks)) if masks else df


def row_loss(df: DataFrame, limits: Limits, mode: str = "all") -> DataFrame:
    """Rows before and after outlier removal, in one pass over the table."""
    columns = list(limits)[-1:] if mode == "last" else list(limits)
    kept = reduce(lambda a, b: a & b, [null_safe_not(_outside(c, limits[c])) for c in columns])
    return (df.agg(F.count("*").alias("rows"), F.count_if(~kept).alias("removed"))
            .withColumn("removed_percent", 100.0 * safe_ratio("removed", "rows")))


def retail_clean(lines: DataFrame) -> DataFrame:
    """Complete lines without cancelled invoices, with positive quantity and price, and their total."""
    return (lines.na.drop("any")
            .where(null_safe_not(F.col("invoice").contains("C")))
            .where((F.col("quantity") > 0) & (F.col("unit_price") > 0))
            .withColumn("total_price", line_total("quantity", "unit_price")))
