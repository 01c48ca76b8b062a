"""The registered model queries run every learner with its defaults, five folds and the whole grids."""

import pytest

from clientele.operators import clusters, models
from clientele.plans import churn_model, model_queries
from clientele.plans.registry import all_queries

ALL = [(m.name, m.params) for m in models.LEARNERS]
TREES = [(m.name, m.params) for m in models.LEARNERS if m.name in models.GRIDS]
VOTERS = ("XGBoost", "LightGBM", "RF")


@pytest.fixture
def calls(spark, monkeypatch):
    made = []
    nothing = spark.createDataFrame([], "model string")
    own = lambda learners: [(m.name, m.params) for m in learners]
    monkeypatch.setattr(model_queries, "_model_rows", lambda *a, **k: (nothing, []))
    monkeypatch.setattr(model_queries, "_folded", lambda data: data)
    monkeypatch.setattr(model_queries.sampling, "undersample", lambda data, *a, **k: data)
    monkeypatch.setattr(models, "voting", lambda learners: made.append(own(learners)) or learners[0])
    monkeypatch.setattr(models, "compare_models", lambda df, learners, folds: made.append((own(learners), folds)) or df)
    monkeypatch.setattr(models, "importance_rows", lambda df, learners, names, folds: made.append((own(learners), folds)) or df)
    monkeypatch.setattr(models, "hybrid_importance", lambda rows, names: rows)
    monkeypatch.setattr(models, "tune", lambda df, grids, folds: made.append((grids, folds)) or df)
    monkeypatch.setattr(model_queries, "stage", lambda df, name: df)
    monkeypatch.setattr(churn_model, "train_and_score", lambda data, *a, **k: nothing.selectExpr("model", "0 is_test"))
    monkeypatch.setattr(model_queries.metrics, "band_summary", lambda df: df)
    monkeypatch.setattr(model_queries.metrics, "class_metrics", lambda df, *a: df)
    monkeypatch.setattr(model_queries.metrics, "mean_metrics", lambda df, *a: df)
    monkeypatch.setattr(model_queries, "_rfm", lambda *a: None)
    monkeypatch.setattr(clusters, "elbow", lambda rfm, most, starts: made.append((most, starts)))
    return lambda name: all_queries()[name].run(spark, "") and made or made


@pytest.mark.parametrize("name", ["model_compare", "model_compare_all_columns", "model_compare_undersampled"])
def test_comparisons(calls, name):
    assert calls(name) == [(ALL, (0, 1, 2, 3, 4))]


def test_importance_and_grids(calls):
    assert calls("feature_importance") == [(TREES, (0, 1, 2, 3, 4))]
    assert calls("grid_search")[1:] == [(models.GRIDS, (0, 1, 2, 3, 4))]


@pytest.mark.parametrize("name", ["voting_bands", "voting_metrics", "voting_fold_means"])
def test_voting(calls, name):
    assert calls(name)[0] == [(m.name, m.params) for m in models.LEARNERS if m.name in VOTERS]


def test_elbow(calls):
    assert calls("elbow") == [(10, 10)]
