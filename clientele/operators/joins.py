"""Joins of features back to order lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# A key with more than this share of the rows is spread over several tasks. At most
# 1 / HOT_SHARE keys can be that frequent, so their list is bounded.
HOT_SHARE = 0.005
# Rows of one key that a task joins.
TASK_ROWS = 1_000_000


def heavy_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> dict[object, int]:
    """Keys that may hold more than ``share`` of the rows, with an upper-side row estimate.

    A frequency sketch merged map-side: no shuffle by key, and the driver gets at most
    2 / share entries.
    """
    k = math.ceil(2 / share)
    row = df.agg(F.count(key).alias("n"),
                 F.expr(f"approx_top_k({key}, {k}, {min(100_000, 50 * k)})").alias("top")).first()
    if not row["n"]:
        return {}
    return {t["item"]: t["count"] for t in row["top"]
            if t["item"] is not None and t["count"] > share * row["n"]}


def heavy_keys_by_count(features: DataFrame, key: str, rows: str,
                        share: float = HOT_SHARE) -> dict[object, int]:
    """As ``heavy_keys``, from a row count that the (cached) feature rows already carry."""
    whole = features.agg(F.sum(rows).alias("n"), F.max(rows).alias("top")).first()
    if not whole["n"] or whole["top"] <= share * whole["n"]:
        return {}
    frequent = features.where(F.col(rows) > F.lit(share * whole["n"]))
    return {r[0]: r[1] for r in frequent.select(key, rows).collect()}


def salts_of(hot: dict[object, int], task_rows: int = TASK_ROWS) -> dict[object, int]:
    """How many tasks the rows of each frequent key are spread over, for those that need more than one."""
    return {k: math.ceil(n / task_rows) for k, n in hot.items() if n > task_rows}


def attach(lines: DataFrame, features: DataFrame, key: str, how: str = "left",
           share: float = HOT_SHARE, rows: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Join features (one row per key) to lines; a key that is very frequent is salted.

    The rows of a frequent key are spread over as many salts as give ``task_rows`` to each, and its
    one feature row is copied to each of them, so the join is one ordinary equi-join. Any salt gives
    the right partner, because all of them exist on the feature side. ``rows`` names a feature
    column with the key's number of lines (used up here); without it a sketch over the lines finds
    the frequent keys.
    """
    if rows:
        hot = heavy_keys_by_count(features, key, rows, share)
        features = features.drop(rows)
    else:
        hot = heavy_keys(lines, key, share)
    salts = salts_of(hot, task_rows)
    if not salts:
        return lines.join(features, key, how)
    known = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])  # at most 2 / share keys
    is_hot = F.col(key).isin(list(salts))
    # Content and input partition decide the salt: equal rows of different partitions spread too,
    # and a recomputed task sends every row to the same place as before.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in lines.columns])
                    + F.spark_partition_id(), F.element_at(known, F.col(key)))
    left = lines.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)).cast("long"))
    right = features.withColumn("_salt", F.explode(F.when(
        is_hot, F.sequence(F.lit(0).cast("long"), F.element_at(known, F.col(key)).cast("long") - 1)
    ).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def drop_matching(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``part``."""
    return df.join(part.select(key).distinct(), key, "left_anti")


def update_matching(df: DataFrame, keys: DataFrame, key: str, target: str, value: Column,
                    unique: bool = False) -> DataFrame:
    """Set ``target`` to ``value`` on every row whose key occurs in ``keys``.

    ``unique`` says that no key has many rows in ``df``, which saves looking for frequent ones.
    """
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    out = df.join(marks, key, "left") if unique else attach(df, marks, key)
    return out.withColumn(target, F.when(F.col("_hit"), value).otherwise(F.col(target))).drop("_hit")


def with_scalars(df: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as scalar subqueries."""
    return df.withColumns({c: aggregated.select(c).scalar() for c in aggregated.columns})
