"""Classification metrics as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.scalars import probability_band, safe_ratio, threshold_flag
from clientele.operators.order_stats import running_totals
from clientele.session import stage


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows per label (rows) and prediction (columns)."""
    counted = df.groupBy(F.col(label).cast("long").alias("label")).pivot(predicted, [0, 1]).count()
    return counted.select("label", F.coalesce("0", F.lit(0)).alias("predicted_0"),
                          F.coalesce("1", F.lit(0)).alias("predicted_1"))


def _rates(y: Column, p: Column) -> list[Column]:
    tp, fp = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1))
    fn, tn = F.count_if((y == 1) & (p == 0)), F.count_if((y == 0) & (p == 0))
    return rates_of(tp, fp, fn, tn)


def rates_of(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Accuracy, F1, precision and recall from the four counts."""
    zero = F.lit(0.0)  # a rate without cases counts as 0
    return [safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
            F.coalesce(safe_ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
            F.coalesce(safe_ratio(tp, tp + fp), zero).alias("precision"),
            F.coalesce(safe_ratio(tp, tp + fn), zero).alias("recall")]


def class_metrics(df: DataFrame, label: str = "label", prob: str = "prob",
                  fold: str | None = None, folds: Sequence = (0,), cut: float = 0.5) -> DataFrame:
    """Accuracy, F1, precision and recall of the positive class, and AUC, per fold."""
    rows = df.withColumn("_fold", F.col(fold) if fold else F.lit(0)).select(
        F.col("_fold").alias("fold"), F.col(label).cast("int").alias("y"), F.col(prob).alias("p"))
    rows = stage(rows, "scored")  # read for the rates and for the area; scoring is the costly part
    rates = rows.groupBy("fold").agg(*_rates(F.col("y"), threshold_flag("p", cut)))
    return rates.join(auc(rows, "y", "p", "fold", folds), "fold")


def auc(df: DataFrame, label: str, prob: str, fold: str, folds: Sequence) -> DataFrame:
    """Exact area under the ROC curve per fold, by counting negatives below each positive.

    All folds share one table of distinct probabilities, so equal scores are one row.
    """
    y, at = F.col(label), F.col(fold)
    cells = []
    for i, f in enumerate(folds):
        cells += [F.count_if((at == F.lit(f)) & (y == 1)).alias(f"p{i}"),
                  F.count_if((at == F.lit(f)) & (y == 0)).alias(f"n{i}")]
    table = stage(df.where(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("v")).agg(*cells), "auc")
    ranked = running_totals(table, "v", [f"n{i}" for i in range(len(folds))])
    wins = [F.sum(F.col(f"p{i}") * (F.col(f"below_n{i}") + F.col(f"n{i}") / 2.0)) for i in range(len(folds))]
    row = ranked.agg(*[c for i, w in enumerate(wins) for c in (
        w.alias(f"w{i}"), F.sum(f"p{i}").cast("double").alias(f"p{i}"),
        F.sum(f"n{i}").cast("double").alias(f"n{i}"))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("fold"),
                 safe_ratio(F.col(f"w{i}"), F.col(f"p{i}") * F.col(f"n{i}")).alias("auc"))
        for i, f in enumerate(folds)])).alias("r")).select("r.*")


def mean_metrics(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = ["auc", "accuracy", "f1", "precision", "recall"]
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(m) for m in names if m in per_fold.columns])


def soft_vote(df: DataFrame, probs: Sequence[str], out: str = "prob") -> DataFrame:
    """Mean of the models' probabilities, and the class it gives."""
    total = F.lit(0.0)
    for p in probs:
        total = total + F.col(p)
    mean = total / F.lit(float(len(probs)))
    return df.withColumn(out, mean).withColumn("predicted", threshold_flag(out))


def score_rows(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Add the 0.5 flag and the probability band."""
    return df.withColumn("predicted", threshold_flag(prob)).withColumn("band", probability_band(prob))


def band_summary(scored: DataFrame, prob: str = "prob", customer: str = "customer_id",
                 value: str = "value") -> DataFrame:
    """Per band: mean probability, rows, distinct customers and revenue."""
    return scored.where("band is not null").groupBy("band").agg(
        F.avg(prob).alias("mean_prob"), F.count("*").alias("n_rows"),
        F.countDistinct(customer).alias("n_customers"),
        F.sum(value).cast("double").alias("revenue"))
