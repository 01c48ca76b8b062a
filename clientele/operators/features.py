"""Feature preparation: dummy columns, scalers, place segments, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, functions as F

from clientele.operators.joins import attach
from clientele.operators.order_stats import bin_of, exact_quantiles, label_of, quantile_edges
from clientele.session import stage

MAX_LEVELS = 200
# A table of places up to this many rows is sent to every executor.
BROADCAST_ROWS = 100_000
# Labels of the place segments, lowest sales first.
CITY_LABELS = ("E", "D", "C", "B", "A")
# The columns the churn label was made from; a model that may use them only repeats the rules.
LEAKING = ("recency", "frequency", "monetary", "recency_score", "frequency_score",
           "monetary_score", "total_transaction", "total_unit", "total_price", "avg_order_value",
           "purchase_frequency", "profit_margin", "customer_value", "cltv", "rfm_score",
           "segment")


def levels(df: DataFrame, columns: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null values per column; an error for a column with more than ``most``.

    The sketch only keeps columns with very many values from being collected.
    """
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    narrow = [c for c in columns if row[c] <= 2 * most]
    got = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in narrow]).first() if narrow else {}
    wide = [c for c in columns if c not in narrow or len(got[c]) > most]
    if wide:
        raise ValueError(f"more than {most} levels for dummy columns: {wide}")
    return {c: list(got[c]) for c in columns}


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = True,
            most: int = MAX_LEVELS) -> DataFrame:
    """0/1 column ``<column>_<level>`` per level in place of the columns; NULL gives all zeros."""
    found = levels(df, columns, most)
    added = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("long"), F.lit(0).cast("long"))
             for c in columns for v in found[c][1 if drop_first else 0:]}
    return df.withColumns(added).drop(*columns)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − median) / interquartile range, all from exact quantiles; a zero range counts as 1."""
    got = exact_quantiles(df, {c: (c, [0.25, 0.5, 0.75]) for c in columns})
    out = {}
    for c, (q1, med, q3) in got.items():
        if med is not None:
            out[c] = (F.col(c).cast("double") - F.lit(med)) / F.lit((q3 - q1) or 1.0)
    return df.withColumns(out)


def minmax_scale(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x − min) / (max − min); 0 for a constant column."""
    bounds = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns
                      for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is not None:
            out[c + suffix] = (F.col(c).cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    return df.withColumns(out)


def city_segments(lines: DataFrame, city: str = "city", value: str = "value",
                  labels: Sequence[str] = CITY_LABELS) -> DataFrame:
    """Sales per place and its equal-frequency segment."""
    sales = stage(lines.where(F.col(city).isNotNull()).groupBy(city)
                  .agg(F.sum(value).cast("double").alias("sales")), "sales")
    edges = quantile_edges(sales, {"sales": ("sales", len(labels))})["sales"]
    return sales.withColumn("city_segment", label_of(bin_of("sales", edges), labels))


def with_city_segment(lines: DataFrame, city: str = "city", value: str = "value") -> DataFrame:
    """Add the segment of each line's place; the places are broadcast if they are few."""
    places = city_segments(lines, city, value).drop("sales")
    if places.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(places), city, "left")
    return attach(lines, places, city)


def assemble(df: DataFrame, features: Sequence[str], label: str,
             keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector, ``label`` and the kept columns; a missing feature is an error."""
    out = VectorAssembler(inputCols=list(features), outputCol="features",
                          handleInvalid="error").transform(df)
    return out.select(*keep, F.col(label).cast("double").alias("label"), "features")


def slice_features(df: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """``df`` with the named features of an assembled vector only, in the order given.

    The names come from the vector's metadata, so nothing is encoded or scaled again.
    """
    cut = VectorSlicer(inputCol=column, outputCol="_sliced", names=list(names)).transform(df)
    return cut.drop(column).withColumnRenamed("_sliced", column).select(*df.columns)
