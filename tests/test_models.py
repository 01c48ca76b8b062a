import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clientele.operators import clusters, metrics, models, neighbours


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.4).astype(float)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "fold": np.arange(n) % 2})
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    return df.select("features", "label", "fold").cache()


@pytest.mark.parametrize("name,floor,params", [
    ("LR", .8, {}), ("KNN", .9, {}), ("KNN", .88, {"fit_rows": 100}), ("SVC", .85, {"components": 60, "max_iter": 20}), ("CART", .8, {"max_depth": 5}),
    ("RF", .9, {"trees": 10, "max_depth": 6}), ("Adaboost", .85, {"rounds": 10}),
    ("GBM", .9, {"rounds": 5}), ("XGBoost", .88, {"rounds": 5})])
def test_learners_beat_a_floor(data, name, floor, params):
    learner = next(m for m in models.LEARNERS if m.name == name).with_params(**params)
    scores = models.cross_validate(data, learner, (0, 1)).collect()
    assert len(scores) == 2 and all(r.auc > floor for r in scores)


def test_grid_and_importance(data):
    best, table = models.grid_search(data, models.CART, {"max_depth": [1, 5]}, (0, 1))
    assert best.params["max_depth"] == 5 and table.count() == 2
    rows = models.importance_rows(data, [models.CART.with_params(max_depth=4)], ["a", "b", "c"], (0, 1))
    wide = models.hybrid_importance(rows, ["CART"])
    assert models.select_features(wide, 50.0) == ["a"]


def test_voting_is_the_mean(data):
    a, b = models.CART.with_params(max_depth=2)(data), models.LOGISTIC(data)
    both = models.vote_scorer([a, b])(data).withColumnRenamed("prob", "v").drop("predicted")
    check = b.score(a.score(both).withColumnRenamed("prob", "pa"))
    assert check.where(F.abs(F.col("v") - (F.col("pa") + F.col("prob")) / 2) > 1e-9).count() == 0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, .9), (0, .9), (1, .4), (0, .1), (0, .4)], "label int, prob double")
    got = metrics.class_metrics(df).first()
    pos, neg = [.9, .4], [.9, .1, .4]
    assert got.auc == sum((p > n) + .5 * (p == n) for p in pos for n in neg) / 6
    assert (got.precision, got.recall) == (.5, .5)


def test_kmeans_assigns_to_the_nearest_centre(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, .1, (30, 3)) for c in ((0, 0, 0), (5, 5, 5), (0, 9, 0))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)],
                               "customer_id long, recency double, frequency double, monetary double")
    got = clusters.cluster_customers(df, k=3, starts=3)
    assert sorted(r.n for r in clusters.cluster_profile(got).collect()) == [30, 30, 30]
    wcss = [r.wcss for r in clusters.elbow(df, most=3, starts=2).orderBy("k").collect()]
    assert wcss[0] > wcss[1] > wcss[2]


@pytest.mark.parametrize("chunk,pivots", [(4000, None), (60, 8)])
def test_neighbours_equal_brute_force(spark, chunk, pivots):
    rng = np.random.default_rng(1)
    n, k = 400, 5
    x = rng.normal(size=(n, 3)).round(1)
    x[:140] = [.3, .3, .3]  # a third are copies
    ids = rng.permutation(n) * 3
    df = spark.createDataFrame([(int(i), *map(float, p), int(i) % 2) for i, p in zip(ids, x)],
                               "id long, a double, b double, c double, y long").repartition(6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r.id: [e.id for e in r.neighbours] for r in neighbours.nearest_neighbours(
        df, "id", ["a", "b", "c"], "y", k, chunk=chunk, pivots=pivots).collect()}
    for i in range(n):
        order = np.lexsort((ids, d[i]))
        assert got[ids[i]] == [int(ids[j]) for j in order[order != i][:k]]
