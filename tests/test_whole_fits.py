"""Fits see all rows of the other folds: small tables whole in every task, large ones dealt."""

import pickle
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clientele.operators import all_row_fits, fit_search, models, neighbours
from clientele.operators.fit_search import Run

N = 24_000


def _frame(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, 3)), rng.integers(0, 2, (n, 3))], axis=1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0) ^ (rng.random(n) < .1)).astype(float)
    pdf = pd.DataFrame({"x": list(x), "label": y, "fold": np.arange(n) % 3})
    return spark.createDataFrame(pdf).select(array_to_vector("x").alias("features"), "label", F.col("fold").cast("int").alias("fold"))


@pytest.fixture(scope="module")
def large(spark):
    return _frame(spark, N).cache()


@pytest.fixture(scope="module")
def small(spark):
    return _frame(spark, 900).cache()


def test_tree_fits_see_all_rows(large, monkeypatch):
    """F14 to F23: no fit runs on a sample."""
    seen = []
    real = all_row_fits.fit_data
    monkeypatch.setattr(all_row_fits, "fit_data", lambda df: seen.append(real(df)) or seen[-1])
    grown = models.CART.with_params(max_depth=2)
    models.compare_models(large, [grown], (0, 1, 2))
    models.compare_models(large, [models.voting([grown])], (0, 1, 2))
    models.tune(large, {"CART": {"max_depth": [1]}}, (0, 1, 2))
    models.grid_search(large, models.CART, {"max_depth": [1]}, (0, 1, 2))
    models.importance_rows(large, [grown], list("abcdef"), (0, 1, 2))
    assert [len(d.label) for d in seen] == [N] * 5


def test_learners_of_one_fold_see_all_other_rows(large):
    """F16, F18, F19: nor does a learner that is fitted by itself."""
    seen = []

    def fit(train):
        seen.append(train.count())
        return models.Fitted(lambda df: df.withColumn("prob", F.lit(.5)))
    models.cross_validate(large, models.Learner("own", fit), (0, 1, 2))
    assert seen == [N * 2 // 3] * 3


def test_nearest_rows_are_sought_among_all(spark):
    """F16, F18, F19: 12 000 rows that differ, and each is its own nearest."""
    df = spark.range(12_000).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"),
                                    (F.xxhash64("id") % 2 == 0).cast("double").alias("label"))
    assert models.fit_knn(df, k=1).score(df).where("prob <> label").count() == 0


def test_dealt_fits_equal_whole_ones(small, monkeypatch):
    monkeypatch.setattr(all_row_fits, "FITS_AT_ONCE", 4)
    whole, dealt = fit_search.fit_set(small), all_row_fits.Dealt(small)
    dealt.edges = whole.edges
    runs = [Run("XGBoost", (("rounds", 6), ("features", "0.5"))), Run("Adaboost", (("rounds", 8),)), Run("CART", (("min_rows", 9),)),
            Run("CatBoost", (("rounds", 4), ("min_rows", 7)))]
    jobs = [(r.family(), r.steps(), k) for r in runs for k in (0, 1, None)]
    a, b = [{(r["family"], r["fold"]): pickle.loads(bytes(r["model"])) for r in own.fits(small, jobs).collect()} for own in (whole, dealt)]
    assert len(a) == len(b) == len(jobs)
    codes = whole.codes[::7]
    for (family, fold), (start, trees) in a.items():
        other = b[family, fold]
        assert start == pytest.approx(other[0]) and len(trees) == len(other[1])
        assert all(len(t) == (5 if fold < 0 else 4) for _, t in other[1])
        settings = fit_search.settings_of(family, len(trees))
        p, q = [next(fit_search.probabilities(settings, s, t, codes, [len(trees)]))[1] for s, t in (a[family, fold], other)]
        assert np.allclose(p, q)


def test_comparison_of_dealt_rows(small, monkeypatch):
    learners = [m for m in models.LEARNERS if m.name in ("KNN", "SVC", "RF", "GBM", "Adaboost")]
    learners = [m.with_params(**{"RF": {"trees": 20}, "GBM": {"rounds": 20}, "SVC": {"components": 60}}.get(m.name, {})) for m in learners]
    one = {(r.model, r.fold): r for r in models.compare_models(small, learners, (0, 1, 2)).collect()}
    monkeypatch.setattr(all_row_fits, "LOCAL_BYTES", 0)
    monkeypatch.setattr(all_row_fits, "TREES_AT_ONCE", 7)
    monkeypatch.setattr(models, "KNN_ROWS", 0)
    monkeypatch.setattr(models, "PROJECTED", 0)
    two = {(r.model, r.fold): r for r in models.compare_models(small, learners, (0, 1, 2)).collect()}
    assert set(one) == set(two) and len(two) == 15
    for key, r in two.items():
        assert r.auc == pytest.approx(one[key].auc, abs=1e-9 if key[0] == "KNN" else .05), key


def test_dealt_rows_of_one_class(small, monkeypatch):
    monkeypatch.setattr(all_row_fits, "LOCAL_BYTES", 0)
    got = models.compare_models(small.withColumn("label", F.lit(0.0)), [models.GBM, models.CART, models.ADABOOST], (0, 1, 2)).collect()
    assert len(got) == 9 and all(r.accuracy == 1.0 and r.auc is None for r in got)


@pytest.mark.parametrize("chunk", [10_000, 150])
def test_votes_of_the_nearest_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1200, 2)).round(1), rng.integers(0, 2, (1200, 4))], axis=1)
    x[:200] = x[0]  # copies with both labels
    y, h = (rng.random(1200) < .4).astype(float), rng.permutation(1200)
    asked = np.concatenate([x[::9], rng.normal(size=(40, 6))])
    points = spark.createDataFrame([(p.tolist(), float(v), int(i)) for p, v, i in zip(x, y, h)], "x array<double>, label double, h long")
    got = neighbours.vote_of_nearest(points, spark.createDataFrame([(p.tolist(),) for p in asked], "x array<double>"), 5, chunk=chunk).collect()
    assert len(got) == len(np.unique(asked, axis=0))
    for r in got:
        d = np.sqrt(((x - np.array(r.x)) ** 2).sum(axis=1))
        assert r.prob == pytest.approx(y[np.lexsort((h, d))[:5]].mean())


def test_no_points(spark):
    points = spark.createDataFrame([], "x array<double>, label double, h long")
    got = neighbours.vote_of_nearest(points, spark.createDataFrame([([1.0],), ([1.0],)], "x array<double>")).collect()
    assert [(r.x, r.prob) for r in got] == [([1.0], None)]


def test_frames_before_the_folds_are_deleted(spark, monkeypatch):
    """of the steps to the folds only the last stays, and a comparison writes no copy of it."""
    from clientele import session
    from clientele.plans import model_queries
    made = []
    real = session.shared_folder
    monkeypatch.setattr(session, "shared_folder", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    folded, names = model_queries._folded_rows(spark, "/root/testdata/sf0.001")
    left = [p for p in (m.removeprefix("file:") for m in made) if Path(p).exists()]
    assert len(left) == 1 and left[0] in folded.inputFiles()[0] and folded.count() == 6000 and len(names) > 5
    assert session.staged(folded) is folded
