"""Two-group hypothesis tests.

Every statistic is made of grouped aggregates; only those few numbers reach the driver, where the
tail probability is one function call. Rank-based tests work on the table of distinct values with
their counts, so a frequent value is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.special import (
    inverse_normal, p_two_sided_t, p_two_sided_z, p_upper_f, p_upper_z)
from clientele.operators.order_stats import exact_quantiles, rank_first, running_totals
from clientele.session import stage

NORMAL = NormalDist()
# Sample size up to which the approximation behind the Shapiro-Wilk p-value was made.
SHAPIRO_TESTED_N = 5000
# Polynomial coefficients (rising powers) of Royston's 1995 algorithm.
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_GAMMA = (-2.273, 0.459)
ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_SD = (-0.4803, -0.082676, 0.0030302)


def group_stats(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sum of each metric per group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.sum(m).alias(f"{m}_sum"))])


def _clean(df: DataFrame, group: str, metric: str, groups: Sequence) -> DataFrame:
    v = F.col(metric).cast("double")
    return df.where(F.col(group).isin(list(groups)) & v.isNotNull() & ~F.isnan(v)).select(
        F.col(group).alias("g"), v.alias("v"))


def _moments(samples: DataFrame, groups: Sequence) -> list[tuple[int, float, float]]:
    """(n, mean, variance) per group, in the order of ``groups``."""
    got = {r["g"]: (r["n"], r["m"], r["s"]) for r in samples.groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).collect()}
    return [got.get(g, (0, None, None)) for g in groups]


def t_test(df: DataFrame, group: str, metric: str, groups: Sequence) -> tuple[float | None, float | None]:
    """Two-sample t with pooled variance: statistic and two-sided p."""
    (n1, m1, s1), (n2, m2, s2) = _moments(_clean(df, group, metric, groups), groups)
    if n1 < 2 or n2 < 2:
        return None, None
    pooled = ((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)
    if pooled <= 0:
        return None, None
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return t, p_two_sided_t(t, n1 + n2 - 2)


def levene(df: DataFrame, group: str, metric: str, groups: Sequence) -> tuple[float | None, float | None]:
    """Equality of variances around the group medians: F statistic and p."""
    samples = _clean(df, group, metric, groups)
    medians = exact_quantiles(samples, {
        str(i): (F.when(F.col("g") == F.lit(g), F.col("v")), [0.5]) for i, g in enumerate(groups)})
    center = F
    for i, g in enumerate(groups):
        center = center.when(F.col("g") == F.lit(g), F.lit(medians[str(i)][0]))
    spread = samples.select("g", F.abs(F.col("v") - center).alias("v"))
    parts = _moments(spread, groups)
    n, k = sum(p[0] for p in parts), len(parts)
    if any(p[0] < 2 for p in parts):
        return None, None
    mean = sum(p[0] * p[1] for p in parts) / n
    within = sum((p[0] - 1) * p[2] for p in parts)
    if within <= 0:
        return None, None
    f = (n - k) / (k - 1) * sum(p[0] * (p[1] - mean) ** 2 for p in parts) / within
    return f, p_upper_f(f, k - 1, n - k)


def proportions_z(count1: float, total1: float, count2: float,
                  total2: float) -> tuple[float | None, float | None]:
    """Two-proportion z, pooled, two-sided. None where the pooled variance is not positive."""
    if not total1 or not total2:
        return None, None
    p = (count1 + count2) / (total1 + total2)
    variance = p * (1 - p) * (1 / total1 + 1 / total2)
    if variance <= 0:
        return None, None
    z = (count1 / total1 - count2 / total2) / math.sqrt(variance)
    return z, p_two_sided_z(z)


def proportions_test(df: DataFrame, group: str, count: str, total: str,
                     groups: Sequence) -> tuple[float | None, float | None]:
    sums = {r[0]: (r[1], r[2]) for r in df.where(F.col(group).isin(list(groups))).groupBy(group).agg(
        F.sum(count).cast("double"), F.sum(total).cast("double")).collect()}
    (c1, t1), (c2, t2) = (sums.get(g, (0.0, 0.0)) for g in groups)
    return proportions_z(c1, t1, c2, t2)


def value_table(samples: DataFrame, groups: Sequence) -> DataFrame:
    """Distinct values with the count of each group (n0, n1, …)."""
    return samples.groupBy("v").agg(*[
        F.count_if(F.col("g") == F.lit(g)).alias(f"n{i}") for i, g in enumerate(groups)])


def mann_whitney(df: DataFrame, group: str, metric: str,
                 groups: Sequence) -> tuple[float | None, float | None, float | None]:
    """U of the first group, its z (tie and continuity corrected) and the two-sided p."""
    table = stage(value_table(_clean(df, group, metric, groups), groups), "values")
    ranked = running_totals(table, "v", ["n1"])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    ties = n0 + n1
    row = ranked.agg(
        F.sum(n0 * (F.col("below_n1") + n1 / 2)).alias("u"), F.sum(n0).alias("a"),
        F.sum(n1).alias("b"), F.sum(ties * ties * ties - ties).alias("t")).first()
    if not row["a"] or not row["b"]:
        return None, None, None
    return mann_whitney_z(row["u"], row["a"], row["b"], row["t"])


def mann_whitney_z(u: float, a: float, b: float, tie_term: float):
    n = a + b
    variance = a * b / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if variance <= 0:
        return u, None, None
    gap = u - a * b / 2.0
    z = math.copysign(max(abs(gap) - 0.5, 0.0), gap) / math.sqrt(variance)
    return u, z, p_two_sided_z(z)


# --- Shapiro-Wilk -----------------------------------------------------------------------------

def _score(rank: Column, n: int) -> Column:
    """The normal score of a rank in a sample of n."""
    return inverse_normal((rank - F.lit(0.375)) / F.lit(n + 0.25))


def _poly(c: Sequence[float], x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


def shapiro_p(w: float, n: int) -> float:
    """Upper tail of W by Royston's normalising transformation."""
    if w >= 1.0:
        return 1.0
    if n == 3:
        return max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log1p(-w)
    if n <= 11:
        g = _poly(ROYSTON_GAMMA, n)
        if y >= g:
            return 0.0
        return p_upper_z((-math.log(g - y) - _poly(ROYSTON_SMALL_MEAN, n))
                         / math.exp(_poly(ROYSTON_SMALL_SD, n)))
    ln = math.log(n)
    return p_upper_z((y - _poly(ROYSTON_MEAN, ln)) / math.exp(_poly(ROYSTON_SD, ln)))


def shapiro(df: DataFrame, column: str) -> tuple[int, float | None, float | None]:
    """Sample size, W and p. W uses every row, however many; beyond 5000 rows p is extrapolated.

    The rows are ranked in ordered pieces, and one pass over them gives both sums of the normal scores,
    the ends and the spread. Equal values take the ranks of their group in any order, which leaves the
    sums as they are.
    """
    v = F.col(column).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.monotonically_increasing_id().alias("k"))
    n = values.count()
    if n < 3:
        return n, None, None
    rank = F.col("r")
    score = _score(rank.cast("double"), n)
    places = (1, 2, n - 1, n)
    weighted, squares, variance, *ends = rank_first(values, "v", "k", "r").agg(
        F.sum(F.col("v") * score), F.sum(score * score), F.var_samp("v"),
        *[F.max(F.when(rank == p, F.col("v"))) for p in places]).first()
    if ends[0] == ends[3] or not variance:
        return n, None, None
    w = _shapiro_w(n, tuple(ends), weighted, variance * (n - 1), squares)
    return n, float(w), float(shapiro_p(w, n))


def _shapiro_w(n: int, ends: tuple, weighted: float, spread: float, total: float) -> float:
    """W from the two lowest and two highest values and the sum of value times normal score."""
    m_last, m_second = (NORMAL.inv_cdf((k - 0.375) / (n + 0.25)) for k in (n, n - 1))
    u = 1.0 / math.sqrt(n)
    outer, inner = ends[3] - ends[0], ends[2] - ends[1]
    if n == 3:
        b = math.sqrt(0.5) * outer
    else:
        a_last = m_last / math.sqrt(total) + _poly(ROYSTON_LAST, u)
        if n <= 5:
            phi = (total - 2 * m_last**2) / (1 - 2 * a_last**2)
            b = (weighted - m_last * outer) / math.sqrt(phi) + a_last * outer
        else:
            a_second = m_second / math.sqrt(total) + _poly(ROYSTON_SECOND, u)
            phi = (total - 2 * m_last**2 - 2 * m_second**2) / (1 - 2 * a_last**2 - 2 * a_second**2)
            b = ((weighted - m_last * outer - m_second * inner) / math.sqrt(phi)
                 + a_last * outer + a_second * inner)
    return min(1.0, b * b / spread)


# --- decision flow ----------------------------------------------------------------------------

def ab_test(df: DataFrame, group: str, metrics: Sequence[str], groups: Sequence,
            alpha: float = 0.05) -> DataFrame:
    """Check normality and equal variances, then the t test, or Mann-Whitney if one fails."""
    rows = []
    for m in metrics:
        normal = [shapiro(df.where(F.col(group) == F.lit(g)), m)[2] for g in groups]
        _, equal = levene(df, group, m, groups)
        if all(p is not None and p > alpha for p in [*normal, equal]):
            test, (stat, p) = "t-test", t_test(df, group, m, groups)
        else:
            test, (stat, _, p) = "mann-whitney", mann_whitney(df, group, m, groups)
        rows.append((m, normal[0], normal[1], equal, test, stat, p,
                     None if p is None else p < alpha))
    return df.sparkSession.createDataFrame(
        rows, "metric string, normal_p_a double, normal_p_b double, levene_p double, test string, "
              "statistic double, p double, reject boolean")
