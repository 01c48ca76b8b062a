"""Tree fits side by side: against simple versions, prefixes, and runs on a small frame."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clientele.operators import fit_search as fs, models
from clientele.operators.features import slice_features


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 900
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    y = np.where(rng.random(n) < 0.05, 1 - y, y)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3], "label": y, "fold": np.arange(n) % 3})
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    return df.select("features", "label", "fold").cache()


def slow_split(codes, y, min_rows):
    """The largest drop in squared error of one split."""
    best = 0.0
    whole = ((y - y.mean()) ** 2).sum()
    for f in range(codes.shape[1]):
        for cut in range(fs.BINS):
            low = codes[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= min_rows:
                best = max(best, whole - sum(((s - s.mean()) ** 2).sum() for s in (y[low], y[~low])))
    return best


def test_first_split_is_the_best(data):
    d = fs.fit_set(data)
    tree = fs.grow(d.codes, -d.label, np.ones(len(d.label)), np.arange(4), 1, 5, 0.0)
    assert tree[4][0] == pytest.approx(slow_split(d.codes, d.label, 5))
    value = fs.leaves(tree, d.codes, 1)
    for v in np.unique(value):
        assert v == pytest.approx(d.label[value == v].mean())


def test_leaves_hold_enough_rows(data):
    d = fs.fit_set(data)
    tree = fs.grow(d.codes, -d.label, np.ones(len(d.label)), np.arange(4), 6, 20, 0.0)
    assert np.unique(fs.leaves(tree, d.codes, 6), return_counts=True)[1].min() >= 20


def test_a_long_fit_begins_with_the_short_one(data):
    d = fs.fit_set(data)
    for model, axis in (("XGBoost", "rounds"), ("RF", "trees"), ("Adaboost", "rounds")):
        long, short = fs.Run(model, ((axis, 12),)).settings(), fs.Run(model, ((axis, 5),)).settings()
        a = dict(fs.probabilities(long, *fs.fit_ensemble(long, d.codes, d.label), d.codes, [5, 12]))
        b = dict(fs.probabilities(short, *fs.fit_ensemble(short, d.codes, d.label), d.codes, [5]))
        assert np.allclose(a[5], b[5]) and not np.allclose(a[5], a[12])


def test_every_row_is_scored_once_and_the_order_of_rows_does_not_matter(data):
    runs = [fs.Run("GBM", (("rounds", 5),)), fs.Run("GBM", (("rounds", 9),)), fs.Run("CART")]
    got = [fs.scored_runs(df, runs, (0, 1, 2)).groupBy("run").agg(F.count("*").alias("n"), F.sum("prob").alias("s"))
           .orderBy("run").collect() for df in (data, data.repartition(7))]
    assert [r.n for r in got[0]] == [900] * 3
    assert [r.s for r in got[0]] == pytest.approx([r.s for r in got[1]])


def test_bound_on_the_fit_rows(data):
    few = fs.fit_rows_of(data, 300)
    assert 200 < few.count() < 400 and few.exceptAll(data).count() == 0
    assert fs.fit_rows_of(data, 900).count() == 900


def test_comparison(data):
    learners = [m for m in models.LEARNERS if m.name not in ("SVC", "LR")]
    rows = models.compare_models(data, learners, (0, 1, 2)).collect()
    assert len(rows) == 3 * len(learners)
    assert {r.model for r in rows if r.auc > 0.9} >= {"XGBoost", "LightGBM", "GBM", "RF"}
    assert all(0 <= r[m] <= 1 for r in rows for m in ("auc", "accuracy", "f1", "precision", "recall"))


def test_tuning(data):
    grids = {"XGBoost": {"rate": [0.1, 0.001], "rounds": [3, 30]}, "CART": {"max_depth": [1, 5]}}
    rows = models.tune(data, grids, (0, 1, 2)).collect()
    assert len(rows) == 4 + 1 + 2 + 1 and all(r.n_rows == 900 for r in rows)
    for model in grids:
        own = [r for r in rows if r.model == model]
        best = [r for r in own if r.best]
        assert len(best) == 1 and best[0].auc == max(r.auc for r in own if not r.is_default)
        assert [r.params for r in own if r.is_default] == ["defaults"]
    assert next(r for r in rows if r.model == "CART" and r.best).params == "max_depth=5"


def test_selected_features(data):
    rows = models.importance_rows(data, [models.CART, models.XGB], list("abcd"), (0, 1, 2))
    chosen = models.select_features(models.hybrid_importance(rows, ["CART", "XGBoost"]), 10.0)
    assert chosen == ["a", "b"]
    few = slice_features(data, chosen)
    assert few.columns == data.columns and len(few.first()["features"]) == 2
    out = models.compare_selected(data, [models.GBM], chosen, (0, 1, 2)).groupBy("features", "n_features").agg(
        F.avg("auc").alias("auc")).collect()
    assert {(r.features, r.n_features) for r in out} == {("all", 4), ("selected", 2)} and all(r.auc > 0.9 for r in out)


def test_one_class_and_no_rows(spark, data):
    one = data.withColumn("label", F.lit(0.0))
    got = models.compare_models(one, [models.XGB, models.FOREST, models.ADABOOST], (0, 1, 2)).collect()
    assert len(got) == 9 and all(r.accuracy == 1.0 and r.auc is None for r in got)
