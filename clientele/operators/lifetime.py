"""Probabilistic lifetime value: BG/NBD purchases and Gamma-Gamma spend.

Formulas: Fader, Hardie & Lee (2005), "Counting Your Customers" the Easy Way; Fader & Hardie
(2013), The Gamma-Gamma Model of Monetary Value.

Each evaluation of a fit sends the three or four parameters as constants and gets the sums of the
likelihood and its gradient back from one Spark aggregate. Terms that depend on the number of orders
alone are summed on the driver over how often each number occurs: n orders in all have at most
sqrt(2 n) different numbers. The quasi-Newton search itself runs on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientele.functions.scalars import DAYS_PER_WEEK, as_of_literal, day_diff, shift_days
from clientele.functions.special import gamma_terms, hyp2f1, ln_gamma, log_add_exp
from clientele.operators.customers import as_of_column, staged_totals
from clientele.operators.features import minmax_scale
from clientele.operators.order_stats import bin_of, label_of, quantile_edges
from clientele.session import stage

# Penalties of the two fits, monthly discount, segment labels (lowest value first).
BGNBD_PENALTY = 0.001
GG_PENALTY = 0.01
DISCOUNT = 0.01
CLV_LABELS = ("D", "C", "B", "A")
WEEKS_PER_MONTH = 4.345


@dataclass(frozen=True)
class PurchaseModel:
    """BG/NBD parameters."""

    r: float
    alpha: float
    a: float
    b: float
    log_likelihood: float = math.nan


@dataclass(frozen=True)
class SpendModel:
    """Gamma-Gamma parameters."""

    p: float
    q: float
    gamma: float
    log_likelihood: float = math.nan


def lifetime_summary(lines: DataFrame, as_of: datetime | None = None, weekly: bool = True,
                     repeat_only: bool = False, more_than: int = 1,
                     count_lines: bool = False) -> DataFrame:
    """Recency (last − first order), age (as of − first order), orders and mean spend per order.

    Customers with more than ``more_than`` orders and positive spend are kept. ``repeat_only``
    counts the orders after the first, as in the published model. ``count_lines`` adds ``n_lines``.
    """
    totals = staged_totals(lines)
    unit = F.lit(float(DAYS_PER_WEEK if weekly else 1))
    orders = F.col("orders") - 1 if repeat_only else F.col("orders")
    return (totals.withColumn("monetary", F.col("spend") / F.col("orders"))
            .where((F.col("orders") > more_than) & (F.col("monetary") > 0))
            .select("customer_id", orders.alias("frequency"),
                    (day_diff("last_ts", "first_ts") / unit).alias("recency"),
                    (day_diff(as_of_column(totals, as_of), "first_ts") / unit).alias("age"),
                    "monetary", *(["n_lines"] if count_lines else [])))


# --- likelihoods ------------------------------------------------------------------------------

def bgnbd_loglik(x: Column, tx: Column, age: Column, r: Column, alpha: Column, a: Column,
                 b: Column) -> Column:
    purchases = ln_gamma(r + x) - ln_gamma(r) + r * F.ln(alpha)
    dropout = ln_gamma(a + b) + ln_gamma(b + x) - ln_gamma(b) - ln_gamma(a + b + x)
    active = -(r + x) * F.ln(alpha + age)
    gone = (F.ln(a) - F.ln(b + F.greatest(x, F.lit(1.0)) - F.lit(1.0))
            - (r + x) * F.ln(alpha + tx))
    return purchases + dropout + F.when(x > 0, log_add_exp(active, gone)).otherwise(active)


def gg_loglik(x: Column, m: Column, p: Column, q: Column, gamma: Column) -> Column:
    px = p * x
    return (ln_gamma(px + q) - ln_gamma(px) - ln_gamma(q) + q * F.ln(gamma)
            + (px - F.lit(1.0)) * F.ln(m) + px * F.ln(x) - (px + q) * F.ln(x * m + gamma))


# --- fitting ----------------------------------------------------------------------------------

def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray,
             max_steps: int = 200, tol: float = 1e-6, gain: float = 1e-8) -> tuple[np.ndarray, float]:
    """Quasi-Newton search (BFGS): one call of ``evaluate`` gives a value and its gradient.

    Steps shrink until the value falls enough (Armijo). Ends at a gradient below ``tol``, when two
    steps in a row gain less than ``gain``, relative, or when no step lowers the value any more.
    """
    d = len(start)
    at, inverse = np.asarray(start, dtype=float), np.eye(d)
    f0, g0 = evaluate(at)
    fresh, idle = True, 0
    for _ in range(max_steps):
        if np.max(np.abs(g0)) < tol:
            break
        step = -inverse @ g0
        if step @ g0 >= 0:  # not a descent: start the curvature anew
            inverse, step, fresh = np.eye(d), -g0, True
        step *= min(1.0, 1.0 / np.max(np.abs(step)))
        for _ in range(30):
            f1, g1 = evaluate(at + step)
            if np.isfinite(f1) and f1 <= f0 + 1e-4 * (step @ g0):
                break
            step = step / 4
        else:
            if fresh:
                break
            inverse, fresh = np.eye(d), True
            continue
        change = g1 - g0
        along = step @ change
        if along > 1e-14:
            if fresh:
                inverse = np.eye(d) * (along / (change @ change))
            turn = np.eye(d) - np.outer(step, change) / along
            inverse = turn @ inverse @ turn.T + np.outer(step, step) / along
            fresh = False
        idle = idle + 1 if f0 - f1 < gain * abs(f0) else 0
        at, f0, g0 = at + step, f1, g1
        if idle == 2:
            break
    return at, f0


Sums = Callable[[Sequence[Column]], list[Column]]
Terms = Callable[[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray], tuple[float, np.ndarray]]


def _fit(data: DataFrame, sums: Sums, terms: Terms, names: Sequence[str], start: Sequence[float],
         penalty: float) -> dict[str, float]:
    """Minimise −mean log-likelihood + penalty · Σ θ² over the logarithms of the parameters.

    ``data`` has the columns of ``sums`` with ``x`` and the count ``n``. ``terms`` gets the parameters,
    the different x, their counts, the number of rows and the sums, and gives the log-likelihood with
    its gradient.
    """
    data = stage(data, "fit")
    found = data.groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").toPandas()
    x, n = found["x"].to_numpy(float), found["n"].to_numpy(float)
    total = float(n.sum())
    if not total:
        raise ValueError("no customers to fit")

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray]:
        theta = np.exp(np.clip(point, -30.0, 30.0))
        row = data.agg(*[F.sum(F.col("n") * c) for c in sums([F.lit(float(v)) for v in theta])]).first()
        if any(v is None or not math.isfinite(v) for v in row):
            return math.inf, np.zeros(len(theta))
        value, slope = terms(theta, x, n, total, np.array(row))
        return (-value / total + penalty * float(np.sum(theta**2)),
                theta * (-slope / total + 2.0 * penalty * theta))

    best, value = minimise(evaluate, np.log(np.asarray(start, dtype=float)))
    theta = np.exp(np.clip(best, -30.0, 30.0))
    loglik_sum = -(value - penalty * float(np.sum(theta**2))) * total
    return {**{n: float(v) for n, v in zip(names, theta)}, "log_likelihood": float(loglik_sum)}


def _bgnbd_sums(theta: Sequence[Column]) -> list[Column]:
    r, alpha, a, b = theta
    x, one = F.col("x"), F.lit(1.0)
    seen, met = F.ln(alpha + F.col("age")), F.ln(alpha + F.col("tx"))
    active = -(r + x) * seen
    left = b + F.greatest(x, one) - one
    gone = F.ln(a) - F.ln(left) - (r + x) * met
    alive = F.when(x > 0, one / (one + F.exp(F.least(gone - active, F.lit(700.0))))).otherwise(one)
    dead = one - alive
    return [F.when(x > 0, log_add_exp(active, gone)).otherwise(active), -alive * seen - dead * met,
            -(r + x) * (alive / (alpha + F.col("age")) + dead / (alpha + F.col("tx"))), dead, -dead / left]


def _bgnbd_terms(theta, x, n, total, sums):
    r, alpha, a, b = theta
    (rx, d_rx), (bx, d_bx), (abx, d_abx) = (gamma_terms(v + x) for v in (r, b, a + b))
    (g_r, d_r), (g_b, d_b), (g_ab, d_ab) = (gamma_terms(v) for v in (r, b, a + b))
    value = n @ (rx + bx - abx) + total * (g_ab - g_r - g_b + r * math.log(alpha)) + sums[0]
    both = total * d_ab - n @ d_abx
    return float(value), np.array([n @ d_rx - total * d_r + total * math.log(alpha) + sums[1],
                                   total * r / alpha + sums[2], both + sums[3] / a,
                                   both + n @ d_bx - total * d_b + sums[4]])


def _gg_sums(theta: Sequence[Column]) -> list[Column]:
    p, q, gamma = theta
    x, m = F.col("x"), F.col("m")
    whole = x * m + gamma
    return [x * F.ln(m), F.ln(m), F.ln(whole), x * F.ln(whole), (p * x + q) / whole]


def _gg_terms(theta, x, n, total, sums):
    p, q, gamma = theta
    (whole, d_whole), (px, d_px) = gamma_terms(p * x + q), gamma_terms(p * x)
    g_q, d_q = gamma_terms(q)
    xlnx = n @ (x * np.log(x))
    value = (n @ (whole - px) - total * (g_q - q * math.log(gamma)) + p * sums[0] - sums[1] + p * xlnx
             - p * sums[3] - q * sums[2])
    return float(value), np.array([n @ (x * (d_whole - d_px)) + sums[0] + xlnx - sums[3],
                                   n @ d_whole - total * (d_q - math.log(gamma)) - sums[2],
                                   total * q / gamma - sums[4]])


def bgnbd_fit(summary: DataFrame, penalty: float = BGNBD_PENALTY,
              start: Sequence[float] | None = None) -> PurchaseModel:
    """Fit on the distinct (orders, recency, age) with their counts: bounded by time, not customers.

    Without a ``start`` the search begins at the plain purchase rate.
    """
    if start is None:
        mean = summary.agg(F.avg("frequency").alias("x"), F.avg("age").alias("age")).first()
        start = (1.0, max(mean["age"] / mean["x"], 1e-3) if mean["x"] else 1.0, 1.0, 1.0)
    distinct = summary.select(
        F.col("frequency").cast("double").alias("x"), F.col("recency").cast("double").alias("tx"),
        F.col("age").cast("double").alias("age")).groupBy("x", "tx", "age").agg(
        F.count("*").cast("double").alias("n"))
    return PurchaseModel(**_fit(distinct, _bgnbd_sums, _bgnbd_terms, ("r", "alpha", "a", "b"), start, penalty))


def gg_fit(summary: DataFrame, penalty: float = GG_PENALTY,
           start: Sequence[float] = (1.0, 1.0, 1.0)) -> SpendModel:
    """Fit on the distinct (orders, mean spend) with their counts."""
    data = summary.where("frequency > 0 and monetary > 0").groupBy(
        F.col("frequency").cast("double").alias("x"), F.col("monetary").cast("double").alias("m")).agg(
        F.count("*").cast("double").alias("n"))
    return SpendModel(**_fit(data, _gg_sums, _gg_terms, ("p", "q", "gamma"), start, penalty))


def model_frame(df: DataFrame, model: PurchaseModel | SpendModel) -> DataFrame:
    """The parameters as rows (name, value)."""
    rows = [(k, float(v)) for k, v in vars(model).items()]
    return df.sparkSession.createDataFrame(rows, "parameter string, value double")


# --- prediction -------------------------------------------------------------------------------

def expected_purchases(model: PurchaseModel, x, tx, age, t) -> np.ndarray:
    """Conditional expected number of purchases in the next ``t`` units, on arrays."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    if abs(a - 1.0) < 1e-9:
        a = 1.0 + 1e-9  # removable singularity
    x, tx, age = (np.asarray(v, dtype=float) for v in (x, tx, age))
    head = alpha + age
    series = hyp2f1(r + x, b + x, a + b + x - 1.0, t / (head + t))
    alive = (a + b + x - 1.0) / (a - 1.0) * (1.0 - (head / (head + t)) ** (r + x) * series)
    drop = np.where(x > 0, a / (b + np.maximum(x, 1.0) - 1.0)
                    * (head / (alpha + tx)) ** (r + x), 0.0)
    return alive / (1.0 + drop)


def with_expected(summary: DataFrame, model: PurchaseModel, horizons: dict[str, float]) -> DataFrame:
    """Add the expected purchases for each named horizon; one Arrow pass for all of them."""
    names, times = list(horizons), [float(t) for t in horizons.values()]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def predict(x: pd.Series, tx: pd.Series, age: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: expected_purchases(model, x, tx, age, t)
                             for n, t in zip(names, times)})

    return (summary.withColumn("_e", predict(
        F.col("frequency").cast("double"), F.col("recency").cast("double"),
        F.col("age").cast("double"))).select("*", "_e.*").drop("_e"))


def expected_profit(model: SpendModel, x: str | Column = "frequency",
                    m: str | Column = "monetary") -> Column:
    """Conditional expected spend per purchase."""
    x = F.col(x) if isinstance(x, str) else x
    m = F.col(m) if isinstance(m, str) else m
    return ((F.lit(model.gamma) + x * m) * F.lit(model.p)
            / (F.lit(model.p) * x + F.lit(model.q - 1.0)))


def with_clv(summary: DataFrame, purchase: PurchaseModel, spend: SpendModel, months: int = 3,
             discount: float = DISCOUNT, weeks_per_month: float = WEEKS_PER_MONTH,
             out: str = "clv") -> DataFrame:
    """Discounted value of the purchases expected in the next months (ages are in weeks)."""
    horizons = {f"_m{i}": i * weeks_per_month for i in range(1, months + 1)}
    df = with_expected(summary, purchase, horizons)
    total, before = F.lit(0.0), F.lit(0.0)
    for i in range(1, months + 1):
        total = total + (F.col(f"_m{i}") - before) / F.lit((1.0 + discount) ** i)
        before = F.col(f"_m{i}")
    return df.withColumn(out, expected_profit(spend) * total).drop(*horizons)


def clv_segments(df: DataFrame, value: str = "clv", labels: Sequence[str] = CLV_LABELS) -> DataFrame:
    """Scale the value to 0…1 and cut it into equal-frequency segments."""
    scaled = minmax_scale(df, [value], suffix="_scaled").withColumnRenamed(
        f"{value}_scaled", f"scaled_{value}")
    edges = quantile_edges(scaled, {"v": (f"scaled_{value}", len(labels))})["v"]
    return scaled.withColumn("clv_segment", label_of(bin_of(f"scaled_{value}", edges), labels))


def backtest(lines: DataFrame, valued: DataFrame, days: int = 90) -> DataFrame:
    """Revenue of the last days, of all and of the valued customers, against their predicted value."""
    last = lines.agg(shift_days(F.max("order_ts"), -days)).first()[0]
    recent = (lines.where(F.col("order_ts") > as_of_literal(last))
              .groupBy("customer_id").agg(F.sum("value").alias("recent")))
    joined = recent.join(valued.groupBy("customer_id").agg(F.max("clv").alias("clv")),
                         "customer_id", "full")
    return joined.agg(
        F.coalesce(F.sum("recent"), F.lit(0)).cast("double").alias("revenue_all"),
        F.coalesce(F.sum(F.when(F.col("clv").isNotNull(), F.col("recent"))), F.lit(0))
        .cast("double").alias("revenue_valued"),
        F.sum("clv").alias("predicted"))


def purchase_probabilities(model: PurchaseModel, t: float | np.ndarray, most: int) -> np.ndarray:
    """P(X(t) = x) for x = 0…most in the last dimension, for one t or an array of them."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    lg = lambda v: gamma_terms(v)[0]
    t, x = np.asarray(t, dtype=float)[..., None], np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        growth = np.where(x == 0, 0.0, x * np.log(t / (alpha + t)))  # at t = 0 nobody has bought yet
    counting = np.exp(lg(r + x) - math.lgamma(r) - lg(x + 1.0) + r * np.log(alpha / (alpha + t)) + growth)
    beta = lambda u, v: lg(u) + lg(v) - lg(u + v)
    base = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    total = np.exp(beta(np.full(most + 1, a), b + x) - base) * counting
    if most:
        reached = 1.0 - np.cumsum(counting, axis=-1)[..., :-1]
        total[..., 1:] += np.exp(beta(np.full(most, a + 1.0), b + x[1:] - 1.0) - base) * reached
    return total


def calibration(summary: DataFrame, model: PurchaseModel, most: int = 20) -> DataFrame:
    """Customers by number of purchases (the last row is ``most`` and above): actual and expected.

    Ages are compressed to their distinct values before the model is evaluated, a batch at a time.
    """
    ages = summary.groupBy("age").agg(F.count("*").alias("n"))

    @F.pandas_udf("array<double>")
    def probabilities(age: pd.Series) -> pd.Series:
        p = purchase_probabilities(model, age.to_numpy(dtype=float), most - 1)
        rest = np.maximum(0.0, 1.0 - p.sum(axis=-1, keepdims=True))
        return pd.Series(list(np.concatenate([p, rest], axis=-1)))

    expected = (ages.select("n", F.posexplode(probabilities("age")).alias("purchases", "p"))
                .groupBy(F.col("purchases").cast("long").alias("purchases"))
                .agg(F.sum(F.col("n") * F.col("p")).alias("expected")))
    actual = (summary.groupBy(F.least("frequency", F.lit(most)).cast("long").alias("purchases"))
              .agg(F.count("*").alias("actual")))
    return (expected.join(actual, "purchases", "left")
            .select("purchases", F.coalesce("actual", F.lit(0)).cast("long").alias("actual"), "expected"))
