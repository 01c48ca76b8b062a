"""Customer features from order lines: RFM, descriptive lifetime value, tenure, churn label."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.scalars import as_of_literal, day_diff, safe_ratio, score_text, shift_days
from clientele.operators import order_stats
from clientele.operators.cleaning import Limits, remove_outliers
from clientele.operators.joins import attach
from clientele.session import stage

# Recency scores, frequency scores and the name of the segment they make.
RFM_SEGMENTS = (
    ((1, 2), (1, 2), "hibernating"),
    ((1, 2), (3, 4), "at_Risk"),
    ((1, 2), (5,), "cant_loose"),
    ((3,), (1, 2), "about_to_sleep"),
    ((3,), (3,), "need_attention"),
    ((3, 4), (4, 5), "loyal_customers"),
    ((4,), (1,), "promising"),
    ((5,), (1,), "new_customers"),
    ((4, 5), (2, 3), "potential_loyalists"),
    ((5,), (4, 5), "champions"),
)
PROFIT_MARGIN = 0.38
# Limits of the churn rules (days for tenure and recency, money for cltv).
CHURN_LIMITS = {
    "cltv_mean": 5112.0, "tenure_mean": 555.38,
    "cltv_low": 204.67, "tenure_low": 442.0,
    "recency_from": 90, "recency_to": 112,
}


def customer_totals(lines: DataFrame) -> DataFrame:
    """One row per customer with everything the features below need: a single pass over the lines.

    The lines are first summed per (customer, order): that gives the distinct orders without a
    distinct aggregate, merges map-side, and spreads a very large customer by order.
    """
    per_order = (lines.where(F.col("customer_id").isNotNull())
                 .groupBy("customer_id", "order_id")
                 .agg(F.count("*").alias("n_lines"), F.sum("value").alias("value"),
                      F.sum("quantity").alias("quantity"), F.min("order_ts").alias("first_ts"),
                      F.max("order_ts").alias("last_ts")))
    return per_order.groupBy("customer_id").agg(
        F.sum("n_lines").alias("n_lines"), F.count("order_id").alias("orders"),
        F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("spend"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("double").alias("units"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def staged_totals(lines: DataFrame) -> DataFrame:
    """The totals as a written table.

    Every feature also needs a number over all customers (last order, their count). A subquery
    for it would run the whole join and aggregation over the lines a second time.
    """
    return stage(customer_totals(lines), "totals")


def as_of_column(totals: DataFrame, as_of: datetime | None) -> Column:
    """The analysis time: as given, or one day after the last order (a scalar subquery)."""
    if as_of is not None:
        return as_of_literal(as_of)
    return totals.agg(shift_days(F.max("last_ts"), 1).alias("as_of")).scalar()


def rfm_metrics(lines: DataFrame, as_of: datetime | None = None, positive_only: bool = False,
                count_lines: bool = False) -> DataFrame:
    """Recency in days, number of distinct orders, and spend per customer.

    ``count_lines`` adds ``n_lines``, which ``attach`` uses to find very large customers.
    """
    totals = staged_totals(lines)
    out = totals.select(
        "customer_id",
        day_diff(as_of_column(totals, as_of), F.col("last_ts")).alias("recency"),
        F.col("orders").alias("frequency"), F.col("spend").alias("monetary"),
        *(["n_lines"] if count_lines else []))
    return out.where("monetary > 0") if positive_only else out


def rfm_scores(rfm: DataFrame, duplicates: str = "raise",
               task_rows: int = order_stats.SELECT_ROWS) -> DataFrame:
    """Scores 1–5: low recency is 5, frequency by ordinal rank, monetary by value.

    ``rfm`` is read several times (edges, then scores); ``rfm_metrics`` gives a table made for it.
    """
    probs = order_stats.edge_probs(5)
    positions = {"recency": lambda n: order_stats.quantile_positions(n, probs),
                 "monetary": lambda n: order_stats.quantile_positions(n, probs),
                 "frequency": lambda n: order_stats.cut_positions(n, 5)}
    n, found = order_stats.select_positions(
        rfm, {c: c for c in positions}, lambda name, size: positions[name](size), task_rows)
    edges = {c: order_stats.unique_edges(
        c, order_stats.quantiles_at(n[c], found[c], probs), duplicates)
        for c in ("recency", "monetary")}
    cuts = order_stats.rank_cuts(rfm, "frequency", "customer_id", 5, task_rows,
                                 selected=(n["frequency"], found["frequency"]))
    return rfm.select(
        "*",
        (F.lit(6) - order_stats.bin_of("recency", edges["recency"])).alias("recency_score"),
        order_stats.rank_bin("frequency", "customer_id", cuts).alias("frequency_score"),
        order_stats.bin_of("monetary", edges["monetary"]).alias("monetary_score"),
    ).withColumn("rfm_score", score_text("recency_score", "frequency_score"))


def rfm_segment(recency_score: str = "recency_score",
                frequency_score: str = "frequency_score") -> Column:
    out = F
    for recency, frequency, name in RFM_SEGMENTS:
        out = out.when(F.col(recency_score).isin(*recency)
                       & F.col(frequency_score).isin(*frequency), name)
    return out


def segment_patterns() -> dict[str, str]:
    """The segment table as text patterns on the joined score, e.g. ``[1-2][3-4]``."""
    def digits(scores):
        return str(scores[0]) if len(scores) == 1 else f"[{scores[0]}-{scores[-1]}]"
    return {digits(r) + digits(f): name for r, f, name in RFM_SEGMENTS}


def rfm(lines: DataFrame, as_of: datetime | None = None, positive_only: bool = False,
        duplicates: str = "raise", count_lines: bool = False) -> DataFrame:
    """Metrics, scores and segment per customer."""
    metrics = rfm_metrics(lines, as_of, positive_only, count_lines)
    return rfm_scores(metrics, duplicates).withColumn("segment", rfm_segment())


def segment_profile(scored: DataFrame, metrics=("recency", "frequency", "monetary"),
                    segment: str = "segment") -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_count")]
    return scored.groupBy(segment).agg(*aggs)


def segment_members(scored: DataFrame, name: str) -> DataFrame:
    return scored.where(F.col("segment") == name).select("customer_id")


def descriptive_cltv(lines: DataFrame, margin: float = PROFIT_MARGIN) -> DataFrame:
    """Lifetime value from totals. With no one-order customer the churn rate is 0: value NULL."""
    totals = staged_totals(lines)
    company = totals.agg(
        F.count("*").alias("n"), F.count_if(F.col("orders") > 1).alias("repeaters"))
    n = company.select("n").scalar()
    churn_rate = F.lit(1.0) - safe_ratio(company.select("repeaters").scalar(), n)
    return (totals.select(
                "customer_id", F.col("orders").alias("total_transaction"),
                F.col("units").alias("total_unit"), F.col("spend").alias("total_price"),
                safe_ratio("spend", "orders").alias("avg_order_value"),
                safe_ratio("orders", n).alias("purchase_frequency"),
                (F.col("spend") * F.lit(margin)).alias("profit_margin"))
            .withColumn("customer_value", safe_ratio(
                F.col("avg_order_value") * F.col("purchase_frequency"), churn_rate))
            .withColumn("cltv", F.col("customer_value") * F.col("profit_margin")))


def tenure(lines: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Days since the first order per customer."""
    totals = staged_totals(lines)
    return totals.select("customer_id", day_diff(
        as_of_column(totals, as_of), F.col("first_ts")).alias("tenure"))


def churn_limits_from(lines: DataFrame) -> dict[str, float]:
    """The data-dependent limits of the churn rules: mean and lower quartile over the lines."""
    low = order_stats.exact_quantiles(
        lines, {"cltv": ("cltv", [0.25]), "tenure": ("tenure", [0.25])})
    mean = lines.agg(F.avg("cltv").alias("c"), F.avg("tenure").alias("t")).first()
    return {**CHURN_LIMITS, "cltv_mean": mean["c"], "tenure_mean": mean["t"],
            "cltv_low": low["cltv"][0], "tenure_low": low["tenure"][0]}


def churn_label(limits: dict[str, float] = CHURN_LIMITS) -> Column:
    """1 when one of three rules holds, else 0; a comparison with NULL does not hold."""
    c = F.col
    long_gone = c("recency_score") == 1
    fading = ((c("recency_score") == 2) & (c("frequency_score") <= 2) & (c("monetary_score") <= 2)
              & (c("cltv") <= F.lit(limits["cltv_mean"]))
              & (c("tenure") <= F.lit(limits["tenure_mean"])))
    short_stay = (c("recency").between(limits["recency_from"], limits["recency_to"])
                  & (c("frequency_score") == 1) & (c("monetary_score") == 1)
                  & (c("cltv") <= F.lit(limits["cltv_low"]))
                  & (c("tenure") <= F.lit(limits["tenure_low"])))
    return F.coalesce((long_gone | fading | short_stay).cast("long"), F.lit(0).cast("long"))


def customer_features(lines: DataFrame, as_of: datetime | None = None,
                      duplicates: str = "raise") -> DataFrame:
    """RFM, descriptive lifetime value and tenure of every customer, from one aggregation.

    ``n_lines`` counts the customer's order lines, for joining the features back to them.
    """
    totals = staged_totals(lines)
    when = as_of_column(totals, as_of)
    company = totals.agg(F.count("*").alias("n"),
                         F.count_if(F.col("orders") > 1).alias("repeaters")).first()
    n = F.lit(float(company["n"]))
    churn_rate = F.lit(1.0) - safe_ratio(F.lit(float(company["repeaters"])), n)
    metrics = totals.select(
        "customer_id", day_diff(when, F.col("last_ts")).alias("recency"),
        F.col("orders").alias("frequency"), F.col("spend").alias("monetary"),
        F.col("orders").alias("total_transaction"), F.col("units").alias("total_unit"),
        F.col("spend").alias("total_price"),
        safe_ratio("spend", "orders").alias("avg_order_value"),
        safe_ratio("orders", n).alias("purchase_frequency"),
        (F.col("spend") * F.lit(PROFIT_MARGIN)).alias("profit_margin"),
        day_diff(when, F.col("first_ts")).alias("tenure"), "n_lines",
    ).withColumn("customer_value", safe_ratio(
        F.col("avg_order_value") * F.col("purchase_frequency"), churn_rate)
    ).withColumn("cltv", F.col("customer_value") * F.col("profit_margin"))
    return rfm_scores(metrics, duplicates).withColumn("segment", rfm_segment())


def churn_lines(lines: DataFrame, limits: dict[str, float] = CHURN_LIMITS,
                as_of: datetime | None = None, trim: Limits | None = None,
                trim_mode: str = "last") -> DataFrame:
    """Order lines with all customer features and the churn label.

    With ``trim`` limits, scores and value come from all lines, then the outlying lines are
    dropped and the tenure is counted on the lines that remain.
    """
    features = customer_features(lines, as_of)
    if trim:
        lines = remove_outliers(lines, trim, trim_mode)
        features = features.drop("tenure").join(tenure(lines, as_of), "customer_id")
    return attach(lines, features.withColumn("churn", churn_label(limits)), "customer_id",
                  rows="n_lines")


def churn_shares(lines: DataFrame) -> DataFrame:
    """Share of churned lines and of churned customers, in percent."""
    per_customer = lines.groupBy("customer_id").agg(
        F.max("churn").alias("churned"),
        F.sum("churn").alias("churned_lines"), F.count("churn").alias("labelled_lines"))
    return per_customer.agg(
        (100.0 * safe_ratio(F.sum("churned_lines"), F.sum("labelled_lines"))).alias("line_share"),
        (100.0 * safe_ratio(F.sum("churned"), F.count(
            F.when(F.col("customer_id").isNotNull(), F.col("churned"))))).alias("customer_share"))


def score_bounds(df: DataFrame, score: str, metric: str) -> DataFrame:
    """Smallest and largest metric in every score band."""
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.min(metric).alias("lowest"), F.max(metric).alias("highest"))
