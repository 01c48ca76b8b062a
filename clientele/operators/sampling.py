"""Samples, splits and folds that do not depend on the partitioning.

Every draw orders the rows by a hash of their content and a seed. The wanted number of rows is
then a threshold on that hash, found by exact selection, so drawing is a filter: no global sort
and no large limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clientele.operators.joins import attach, update_matching
from clientele.operators.order_stats import SELECT_ROWS, select_positions
from clientele.session import stage

SPLIT_STEPS = 1_000_000


def row_hash(df: DataFrame, seed: int, key: Sequence[str] | None = None) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in (key or df.columns)], F.lit(seed))


def sample_exact(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 10,
                 key: Sequence[str] | None = None, task_rows: int = SELECT_ROWS) -> DataFrame:
    """Exactly ``n`` rows, or round(frac · rows). ``key`` narrows the hash to identifying columns.

    When the last admitted hash belongs to several rows, a hash of the whole row decides between
    them; rows that are equal in every column are interchangeable, and the missing copies are
    generated from one of them.
    """
    if frac is not None:
        n = round(frac * df.count())
    if not n or n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_hash", row_hash(df, seed, key))
    total, found = select_positions(hashed, {"h": "_hash"}, lambda _, rows: [min(n, rows)], task_rows)
    if n >= total["h"]:
        return df
    cut = next(iter(found["h"].values()))
    if n == cut.less + cut.equal:
        return hashed.where(F.col("_hash") <= F.lit(cut.value)).drop("_hash")
    below = hashed.where(F.col("_hash") < F.lit(cut.value)).drop("_hash")
    ties = hashed.where(F.col("_hash") == F.lit(cut.value)).drop("_hash")
    missing = n - cut.less
    if key:
        return below.unionByName(sample_exact(ties, missing, seed=seed, task_rows=task_rows))
    copies = ties.groupBy(*[F.col(f"`{c}`") for c in ties.columns]).agg(F.lit(1).alias("_one"))
    one = copies.drop("_one").orderBy(*[F.col(f"`{c}`") for c in ties.columns]).first()
    repeated = df.sparkSession.range(missing).select(*[
        F.lit(one[f.name]).cast(f.dataType).alias(f.name) for f in ties.schema])
    return below.unionByName(repeated)


def undersample(df: DataFrame, label: str, n: int | None = None, frac: float | None = None,
                majority=0, seed: int = 10, key: Sequence[str] | None = None) -> DataFrame:
    """All rows of the other classes and a sample of the majority class."""
    large = df.where(F.col(label) == F.lit(majority))
    rest = df.where(~F.col(label).eqNullSafe(F.lit(majority)))
    return sample_exact(large, n, frac, seed, key).unionByName(rest)


def label_noise(lines: DataFrame, rounds: Sequence[tuple[int, float, int | None]], seed: int = 10,
                customer: str = "customer_id", label: str = "churn",
                recency: str = "recency") -> DataFrame:
    """Turn some quiet customers into churners, in rounds of (day_from, keep, day_to).

    Candidates of a round are customers with lines in its recency range none of which is labelled
    1. A share ``keep`` of them stays; the label of every line of the others becomes 1. The rounds
    run on one row per (customer, recency); the lines are read once before and joined once after.
    """
    one = F.lit(1).cast(lines.schema[label].dataType)
    state = (lines.where(F.col(customer).isNotNull()).groupBy(customer, recency)
             .agg(F.max(label).alias(label), F.count("*").alias("_rows")))
    state = stage(state, "noise")
    turned = []
    current = state
    for day_from, keep, day_to in rounds:
        in_range = F.col(recency) >= day_from
        if day_to is not None:
            in_range = in_range & (F.col(recency) < day_to)
        quiet = stage(current.where(in_range).groupBy(customer).agg(F.max(label).alias("_label"))
                      .where("_label = 0").select(customer), "quiet")
        n = quiet.count()
        turned.append(sample_exact(quiet, n=n - round(keep * n), seed=seed))
        current = stage(update_matching(
            current, turned[-1], customer, label, one, unique=True), "noise")
    picked = reduce(DataFrame.unionByName, turned).distinct().withColumn("_hit", F.lit(True))
    marks = (state.groupBy(customer).agg(F.sum("_rows").alias("_rows"))
             .join(picked, customer, "left").select(customer, "_rows", "_hit"))
    return (attach(lines, marks, customer, rows="_rows")
            .withColumn(label, F.when(F.col("_hit"), one).otherwise(F.col(label))).drop("_hit"))


def hash_split(df: DataFrame, test_size: float = 0.3, seed: int = 10,
               key: Sequence[str] | None = None) -> DataFrame:
    """Mark each row ``is_test`` or not. Rows that agree in ``key`` fall on the same side.

    With the customer as key no customer is on both sides.
    """
    cut = round(test_size * SPLIT_STEPS)
    return df.withColumn("is_test", F.pmod(row_hash(df, seed, key), F.lit(SPLIT_STEPS)) < F.lit(cut))


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 10,
                     key: Sequence[str] | None = None, out: str = "fold",
                     task_rows: int = SELECT_ROWS) -> DataFrame:
    """Folds 0…k−1 with the same class mix.

    Within a class the hash range is cut at its exact k-quantiles, so fold sizes differ by one row
    at most (equal rows share a fold, which keeps copies from leaking), and assigning a fold is a
    comparison with k−1 numbers per class. The classes must be few.
    """
    classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct()
               .orderBy(label).limit(101).collect()]
    if len(classes) > 100:
        raise ValueError(f"{label} has more than 100 classes")
    hashed = df.withColumn("_hash", row_hash(df, seed, key))
    cols = {str(i): F.when(F.col(label) == F.lit(c), F.col("_hash")) for i, c in enumerate(classes)}
    _, found = select_positions(
        hashed, cols, lambda _, n: [n * j // k for j in range(1, k)], task_rows)
    fold = F
    for i, c in enumerate(classes):
        number = F.lit(0)
        for cut in sorted({s.value for s in found[str(i)].values()}):
            number = number + (F.col("_hash") > F.lit(cut)).cast("int")
        fold = fold.when(F.col(label) == F.lit(c), number)
    return hashed.withColumn(out, fold).drop("_hash")
