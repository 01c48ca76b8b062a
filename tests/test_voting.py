from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector

from clientele.operators import all_row_fits, fit_search, models
from clientele.operators.fit_search import Run
from clientele.operators.metrics import class_metrics


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 900
    x = np.stack([rng.normal(size=n), rng.normal(size=n).round(1), rng.integers(0, 2, n)], axis=1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=.3, size=n) > .3).astype(float)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "fold": np.arange(n) % 3})
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    return df.select("features", "label", "fold").cache()


def _voters():
    def never(train, **params):
        raise AssertionError("fitted by itself")
    few = {"XGBoost": {"rounds": 4}, "LightGBM": {"rounds": 6}, "RF": {"trees": 5, "max_depth": 4}}
    return [replace(m.with_params(**few[m.name]), fit=never) for m in models.LEARNERS if m.name in few]


def test_folds_of_a_vote_are_fitted_side_by_side(spark, data, monkeypatch):
    monkeypatch.setattr(fit_search, "PASS_BYTES", 1)  # a pass for each fold, its three models together
    voters = _voters()
    got = {r.fold: r for r in models.compare_models(data, [models.voting(voters)], (0, 1, 2)).collect()}
    fits = fit_search.fit_set(data)
    pdf = data.toPandas()
    x, fold = np.vstack([v.toArray() for v in pdf["features"]]), pdf["fold"].to_numpy()
    for k in (0, 1, 2):
        parts = []
        for m in voters:
            settings = Run(m.name, tuple(m.params.items())).settings()
            start, trees = fit_search.fit_ensemble(settings, fits.codes[fits.fold != k], fits.label[fits.fold != k])
            parts.append(next(fit_search.probabilities(settings, start, trees, fits.encode(x[fold == k]), [len(trees)]))[1])
        own = pd.DataFrame({"label": pdf["label"][fold == k].to_numpy(), "prob": np.mean(parts, axis=0)})
        own["predicted"] = (own["prob"] > .5).astype(int)
        want = class_metrics(spark.createDataFrame(own)).first()
        assert got[k].model == "Voting"
        assert all(abs(got[k][c] - want[c]) < 1e-9 for c in ("accuracy", "f1", "precision", "recall", "auc"))


def _dealt(spark, codes, y, parts=5):
    cuts = np.array_split(np.random.default_rng(1).permutation(len(y)), parts + 2)
    return spark.sparkContext.parallelize([(np.ascontiguousarray(codes[c].T), y[c]) for c in cuts], parts)


def _same(got, want):
    assert got[0] == pytest.approx(want[0]) and len(got[1]) == len(want[1])
    for (w, a), (v, b) in zip(got[1], want[1]):
        assert w == v and all((p == q).all() for p, q in zip(a[:3], b[:3])) and np.allclose(a[3], b[3])


def test_fits_over_blocks_equal_fits_of_one_array(spark, data, monkeypatch):
    monkeypatch.setattr(all_row_fits, "RENEW", 3)
    fits = fit_search.fit_set(data)
    base, y, rows = _dealt(spark, fits.codes, fits.label), fits.label, len(fits.label)
    own = [Run("XGBoost", (("rounds", 5),)).settings(), Run("LightGBM", (("rounds", 7), ("min_rows", 9))).settings()]
    for got, s in zip(all_row_fits._boosted(base, y.mean(), own), own):
        _same(got, fit_search.fit_ensemble(s, fits.codes, y))
    monkeypatch.setattr(all_row_fits, "JOB_BYTES", 1)
    s = Run("CART", (("max_depth", 5), ("min_rows", 1))).settings()
    _same((0.0, all_row_fits._forest(base, rows, y.mean(), 3, s)), fit_search.fit_ensemble(s, fits.codes, y))


def test_a_vote_sees_all_rows_without_sparks_learners(spark, data):
    score = models.voting(_voters())(data).score(data)
    found = class_metrics(score).first()
    assert found.auc > .95 and score.count() == 900
    x = spark.range(40_000).selectExpr("array(cast(id as double), double(id > 2)) v", "double(id % 4 = 0 or id < 3) label")
    rare = x.select(array_to_vector("v").alias("features"), "label")
    assert [e[:1].tolist() for e in all_row_fits.edges_of(rare)] == [[0.0], [0.0]]  # three rows of 40 000 are told apart
    assert sum(len(y) for _, y in all_row_fits.blocks_of(rare, all_row_fits.edges_of(rare)).collect()) == 40_000


def test_votes_on_no_rows_and_on_one_class(spark, data):
    voter = models.voting(_voters())
    assert voter(data.limit(0)).score(data).where("prob is not null").count() == 0
    ones = voter(data.where("label = 1")).score(data)
    assert ones.where("prob < 0.999 or prob is null").count() == 0
