"""Profiles of a table: shapes, describes, missing values, column roles, correlations, shares."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientele.functions.scalars import safe_ratio
from clientele.operators.order_stats import exact_quantiles

QUANTILES = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)


def is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def _is_missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _long(row: DataFrame, per_column: dict[str, dict[str, str]], key: str = "column") -> DataFrame:
    """One aggregated row to one row per input column.

    ``per_column`` maps the column's name to output name and field of the aggregated row.
    """
    cells = [F.struct(F.lit(name).alias(key), *[
        F.col(f"`{field}`").alias(out) for out, field in fields.items()])
        for name, fields in per_column.items()]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles and maximum per numeric column."""
    columns = list(columns or numeric_columns(df))
    inner = [q for q in quantiles if 0 < q < 1]
    got = exact_quantiles(df, {c: (c, inner) for c in columns}) if inner else {}
    aggs, fields = [], {}
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}")]
        fields[c] = {"n": f"n{i}", "mean": f"mean{i}", "std": f"std{i}", "min": f"min{i}"}
        for j, q in enumerate(inner):
            fields[c][quantile_name(q)] = f"q{i}_{j}"
        fields[c]["max"] = f"max{i}"
    row = df.agg(*aggs).withColumns({
        f"q{i}_{j}": F.lit(got[c][j]).cast("double")
        for i, c in enumerate(columns) for j in range(len(inner))}) if inner else df.agg(*aggs)
    return _long(row, fields)


def quantile_name(q: float) -> str:
    return "q" + format(q * 100, "g").replace(".", "_")


def check_df(df: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """One row per column: type, rows, missing values and, for numbers, the describe columns."""
    inner = [q for q in quantiles if 0 < q < 1]
    numeric = numeric_columns(df)
    got = exact_quantiles(df, {c: (c, inner) for c in numeric}) if numeric and inner else {}
    none = F.lit(None).cast("double")
    aggs, fields, literals = [F.count("*").alias("rows")], {}, {}
    for i, f in enumerate(df.schema):
        aggs.append(F.count_if(_is_missing(f)).alias(f"miss{i}"))
        literals[f"type{i}"] = F.lit(f.dataType.simpleString())
        fields[f.name] = {"dtype": f"type{i}", "n": "rows", "n_miss": f"miss{i}"}
        stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        x = F.when(~_is_missing(f), F.col(f"`{f.name}`").cast("double")) if f.name in numeric else None
        for s, fn in stats.items():
            if x is not None:
                aggs.append(fn(x).alias(f"{s}{i}"))
            else:
                literals[f"{s}{i}"] = none
            fields[f.name][s] = f"{s}{i}"
        for j, q in enumerate(inner):
            v = got[f.name][j] if f.name in got else None
            literals[f"q{i}_{j}"] = F.lit(v).cast("double")
            fields[f.name][quantile_name(q)] = f"q{i}_{j}"
    return _long(df.agg(*aggs).withColumns(literals), fields)


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent, most missing first."""
    aggs, fields = [F.count("*").alias("rows")], {}
    for i, f in enumerate(df.schema):
        aggs.append(F.count_if(_is_missing(f)).alias(f"miss{i}"))
        fields[f.name] = {"n_miss": f"miss{i}", "rows": "rows"}
    return (_long(df.agg(*aggs), fields).where("n_miss > 0")
            .select("column", "n_miss", F.round(
                100.0 * safe_ratio("n_miss", "rows"), 2).alias("ratio"))
            .orderBy(F.desc("n_miss"), "column"))


def distinct_counts(df: DataFrame, exact_to: int = 60) -> dict[str, int]:
    """Distinct non-null values per column, exact for columns with at most about ``exact_to``.

    One pass sketches all columns; then only those near or below ``exact_to`` are counted exactly,
    where few values make a small shuffle. Roles compare the counts with limits below that.
    """
    names = df.columns
    row = df.agg(*[F.approx_count_distinct(f"`{c}`", 0.02).alias(f"c{i}") for i, c in enumerate(names)]).first()
    counts = {c: row[f"c{i}"] for i, c in enumerate(names)}
    few = [c for c in names if counts[c] <= exact_to]
    if few:
        exact = df.agg(*[F.size(F.collect_set(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(few)]).first()
        counts |= {c: exact[f"c{i}"] for i, c in enumerate(few)}
    return counts


def column_roles(df: DataFrame, category_below: int = 10,
                 cardinal_above: int = 20) -> dict[str, list[str]]:
    """Sort the columns by type and distinct count into categorical, numeric and cardinal."""
    counts = distinct_counts(df, 3 * max(category_below, cardinal_above))
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    few = [c for c in df.columns if c not in text and counts[c] < category_below]
    cardinal = [c for c in df.columns if c in text and counts[c] > cardinal_above]
    return {
        "categorical": [c for c in df.columns if c in text and c not in cardinal] + few,
        "numeric": [c for c in df.columns if c not in text and c not in few],
        "cardinal": cardinal,
    }


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL left out, with the percentage of all rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", 100.0 * safe_ratio("n", total)).orderBy(F.desc("n"), column)


def rare_levels(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Per level of each column: rows, share of all rows, mean target. One pass for all columns."""
    total = df.agg(F.count("*").alias("n")).scalar()
    levels = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"),
                 F.col(target).alias("target")) for c in columns])).alias("r")).select("r.*")
    return (levels.where("level is not null").groupBy("column", "level")
            .agg(F.count("*").alias("n"), F.avg("target").alias("target_mean"))
            .withColumn("ratio", safe_ratio("n", total)))


def target_means(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean target for every combination of the columns' values."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(known).groupBy(*columns).agg(F.avg(target).alias("target_mean"))


def _moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, n, x, y, xx, yy, xy) of each task and pair of columns a <= b: sums over rows that have both.

    Each batch is one matrix, and all sums of all pairs are four products of it with itself.
    """
    d = len(names)
    upper = np.triu_indices(d)

    def run(batches):
        total = None
        for pdf in batches:
            values = pdf.to_numpy(dtype=float)
            known = ~np.isnan(values)
            x, m = np.where(known, values, 0.0), known.astype(float)
            own = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = own if total is None else total + own
        if total is not None:
            sums = total[:, upper[0], upper[1]]
            yield pd.DataFrame({"a": upper[0], "b": upper[1], **dict(zip(("n", "x", "y", "xx", "yy", "xy"), sums))})

    return df.mapInPandas(run, "a int, b int, n double, x double, y double, xx double, yy double, xy double")


def correlations(df: DataFrame, columns: Sequence[str] | None = None,
                 diagonal: bool = False) -> DataFrame:
    """Pearson correlation of each pair (a before b), pairwise complete.

    One pass finds the means, which the values are shifted by so that the sums do not cancel; a second
    one sums the products of all pairs in blocks. A pair with a constant side has no correlation.
    """
    columns = list(columns or numeric_columns(df))
    clean = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        clean.append(F.when(~F.isnan(x), x))
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(clean)]).first()
    shifted = df.select(*[(c - F.lit(means[f"m{i}"] or 0.0)).alias(f"x{i}") for i, c in enumerate(clean)])
    whole = _moments(shifted, columns).groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])
    if not diagonal:
        whole = whole.where("a < b")
    n = F.col("n")
    spread = [F.greatest(F.col(k + k) - F.col(k) * F.col(k) / n, F.lit(0.0)) for k in ("x", "y")]
    # What is left of a constant column after rounding is no spread.
    flat = reduce(lambda a, b: a | b, [s <= F.lit(1e-13) * F.col(k + k) for s, k in zip(spread, ("x", "y"))])
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / (F.sqrt(spread[0]) * F.sqrt(spread[1]))
    r = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    return whole.select(names[F.col("a")].alias("a"), names[F.col("b")].alias("b"), F.col("a").alias("_a"),
                        F.col("b").alias("_b"), F.when((n > 1) & ~flat, r).alias("r"))


def strong_pairs(pairs: DataFrame, at_least: float = 0.75) -> DataFrame:
    return pairs.where((F.col("r") >= at_least) & (F.col("r") != 1))


def ranked_correlations(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """The distinct correlation values, largest first."""
    return (pairs.where("r is not null").select(F.round("r", digits).alias("r"))
            .dropDuplicates().orderBy(F.desc("r")))


def highly_correlated(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Columns that correlate beyond the threshold, either sign, with an earlier column."""
    return pairs.where(F.abs("r") > threshold).select(F.col("b").alias("column")).distinct()


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; the maximum is in the last bin."""
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    number = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    counted = (df.where(x.isNotNull()).groupBy(number.cast("long").alias("bin"))
               .agg(F.count("*").alias("n")))
    frame = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return (frame.join(counted, "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("high"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box_numbers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (last value within reach·IQR) and number of points outside."""
    got = exact_quantiles(df, {c: (c, [0.25, 0.5, 0.75]) for c in columns})
    aggs, fields, literals = [], {}, {}
    for i, c in enumerate(columns):
        q1, med, q3 = (math.nan if q is None else q for q in got[c])
        low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
        x = F.col(c).cast("double")
        inside = x.between(low, high)
        aggs += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"),
                 F.count_if(~inside).alias(f"out{i}")]
        literals |= {f"q1{i}": F.lit(q1), f"md{i}": F.lit(med), f"q3{i}": F.lit(q3)}
        fields[c] = {"whisker_low": f"lo{i}", "q25": f"q1{i}", "q50": f"md{i}", "q75": f"q3{i}",
                     "whisker_high": f"hi{i}", "n_outside": f"out{i}"}
    return _long(df.agg(*aggs).withColumns(literals), fields)


def column_stats(df: DataFrame, by: str, columns: Sequence[str],
                 stats: Sequence[str] = ("count", "mean", "sum")) -> DataFrame:
    """Several aggregates of several columns per group, as ``<column>_<stat>``."""
    make = {"count": F.count, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        *[make[s](c).alias(f"{c}_{s}") for c in columns for s in stats])


def pivot_mean(df: DataFrame, index: str, columns: str, values: str,
               levels: Sequence[str]) -> DataFrame:
    """Mean of ``values`` per index row and known column level."""
    return df.groupBy(index).pivot(columns, list(levels)).agg(F.avg(values))


def head_tail(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First and last rows in the given order."""
    first = df.orderBy(F.asc(order)).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(F.desc(order)).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def slice_rows(df: DataFrame, order: Sequence[Column], start: int, stop: int) -> DataFrame:
    """Rows start…stop−1 of the ordered table."""
    return df.orderBy(*order).offset(start).limit(stop - start)


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, with the columns they all have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*common) for f in frames])
