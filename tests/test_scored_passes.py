"""Models that travel in several passes, rates by ranges of the odds, nearest rows by partition."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from clientele.operators import fit_search, models
from clientele.operators.fit_search import Run
from clientele.operators.metrics import class_metrics


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=.3, size=900) > 0).astype(float)
    rows = [(r.tolist(), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int")
    return df.select(array_to_vector("x").alias("features"), "label", "fold").cache()


def _rows(df):
    return sorted(tuple(None if v is None else round(float(v), 9) for v in r) for r in df.collect())


def test_any_number_of_passes_gives_the_same(data, monkeypatch):
    """F8, F9: the driver never holds more than about PASS_BYTES of models."""
    runs = [Run("CART"), Run("LightGBM", (("rounds", 5),)), Run("LightGBM", (("rounds", 9),)), Run("RF", (("trees", 6),))]
    one = _rows(fit_search.rated_runs(data, runs, (0, 1, 2)))
    monkeypatch.setattr(fit_search, "PASS_BYTES", 1)
    assert _rows(fit_search.rated_runs(data, runs, (0, 1, 2))) == one and len(one) == 12
    scored = fit_search.scored_runs(data, runs, (0, 1, 2)).where("run = 2")
    want = class_metrics(scored, "label", "prob", "fold", (0, 1, 2))
    names = ["fold", "accuracy", "f1", "precision", "recall", "auc"]
    assert _rows(want.select(names)) == _rows(fit_search.rates(scored).select(names))


def test_rates_of_odd_probabilities(spark):
    nan = float("nan")
    rows = [(p, y, k) for k in (0, 1) for p, y in [(0.0, 0), (0.0, 1), (1.0, 1), (1.0, 0), (.5, 1), (.5, 0), (.5, 0), (1e-300, 1),
                                                  (1 - 2 ** -53, 0), (2 ** -53, 0), (None, 1), (.25, None)]]
    rows += [(.3, 1, 2), (.6, 1, 2), (nan, 1, 3), (.9, 0, 3)]
    df = spark.createDataFrame([(0, k, None if y is None else float(y), p) for p, y, k in rows],
                               "run int, fold int, label double, prob double")
    names = ["fold", "accuracy", "f1", "precision", "recall", "auc"]
    want = class_metrics(df, "label", "prob", "fold", (0, 1, 2, 3)).select(names)
    assert _rows(fit_search.rates(df).select(names)) == _rows(want)


def test_nearest_rows_at_equal_distance(spark):
    """Ties go to the earlier rows of the hash's order, as a stable sort has them."""
    rows = [([float(i % 5), float(i % 3)], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    kept = df.select(vector_to_array("features").alias("x"), "label").withColumn("h", F.xxhash64("x", "label")).orderBy("h").collect()
    points, labels = np.array([r["x"] for r in kept]), np.array([r["label"] for r in kept])
    for r in models.fit_knn(df).score(df).distinct().collect():
        z = np.array(r["features"].toArray())
        gap = (points ** 2).sum(axis=1) - 2.0 * points @ z
        assert r["prob"] == pytest.approx(labels[np.argsort(gap, kind="stable")[:5]].mean())
