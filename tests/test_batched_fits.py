"""Correlations in blocks, k-means in batches, gradients of the likelihoods: against simple versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clientele.functions.special import gamma_terms
from clientele.operators import clusters, lifetime as L, profiling


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 88)) + 1e6  # a large mean must not cancel
    x[:, 1] = x[:, 0] * 2 + 1
    x[:, 2] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    names = [f"c{i}" for i in range(88)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r.a, r.b): r.r for r in profiling.correlations(df, diagonal=True).collect()}
    want = pdf.corr()
    assert len(got) == 88 * 89 // 2
    for (a, b), r in got.items():
        if "c2" in (a, b) or "c3" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlations_without_rows(spark):
    df = spark.createDataFrame([], "a double, b long")
    assert [(r.a, r.b, r.r) for r in profiling.correlations(df).collect()] in ([], [("a", "b", None)])
    one = spark.createDataFrame([(1.0, 2)], df.schema)
    assert [r.r for r in profiling.correlations(one).collect()] == [None]


def lloyd(x, centres):
    while True:
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        if np.abs(new - centres).max() <= clusters.TOLERANCE:
            return ((x - centres[own]) ** 2).sum()
        centres = new


def test_models_that_advance_together_equal_single_ones(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, .3, (60, 3)) for c in ((0, 0, 0), (3, 3, 0), (0, 4, 4), (6, 0, 2))])
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))).repartition(4)
    got = clusters.fit_clusters(df, [2, 4, 6], starts=3)
    points = np.array(sorted(map(tuple, x)))
    for k, m in got.items():
        alone = [lloyd(x, clusters._first_centres(points, k, np.random.default_rng([10, k, s]))) for s in range(3)]
        assert m.cost == pytest.approx(min(alone)) and m.centres.shape == (k, 3)
    near = clusters.assign(df, got[4].centres).select("a", "b", "c", "cluster_no").collect()
    for r in near:
        assert r.cluster_no == ((got[4].centres - np.array([r.a, r.b, r.c])) ** 2).sum(1).argmin()


def test_fewer_points_than_centres_and_copies(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "a double"))
    got = clusters.fit_clusters(df, [2, 5], starts=2)
    assert got[2].cost == pytest.approx(0.0) and got[5].cost == pytest.approx(0.0)
    with pytest.raises(ValueError):
        clusters.fit_clusters(df.limit(0), [2])


def test_gamma_terms():
    xs = np.array([1e-3, .1, .5, 1., 2., 7.3, 50., 1e6])
    value, slope = gamma_terms(xs)
    assert value == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)
    h = np.maximum(xs * 1e-4, 1e-8)
    assert slope == pytest.approx([(math.lgamma(x + d) - math.lgamma(x - d)) / (2 * d) for x, d in zip(xs, h)], rel=1e-5)
    assert gamma_terms(1.0)[1] == pytest.approx(-0.5772156649015329, abs=1e-11)


def test_sums_and_terms_give_the_likelihood_and_its_gradient(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 30.0, 5.0, 3.0), (1.0, 4.0, 30.0, 12.0, 1.0), (7.0, 25.0, 41.0, 80.0, 2.0)],
                                 "x double, tx double, age double, m double, n double")
    c = {k: F.col(k) for k in rows.columns}
    cases = [(rows, L._bgnbd_sums, L._bgnbd_terms, lambda t: L.bgnbd_loglik(c["x"], c["tx"], c["age"], *t), [.9, 8.0, .7, 2.1]),
             (rows.where("x > 0"), L._gg_sums, L._gg_terms, lambda t: L.gg_loglik(c["x"], c["m"], *t), [6.0, 4.0, 15.0])]
    for df, sums, terms, loglik, at in cases:
        at = np.array(at)
        whole = lambda p: df.agg(F.sum(c["n"] * loglik([F.lit(float(v)) for v in p]))).first()[0]
        found = df.groupBy("x").agg(F.sum("n").alias("n")).toPandas()
        row = df.agg(*[F.sum(c["n"] * s) for s in sums([F.lit(float(v)) for v in at])]).first()
        value, slope = terms(at, found["x"].to_numpy(), found["n"].to_numpy(), float(found["n"].sum()), np.array(row))
        assert value == pytest.approx(whole(at), rel=1e-10)
        for i in range(len(at)):
            step = np.eye(len(at))[i] * 1e-5 * at[i]
            assert slope[i] == pytest.approx((whole(at + step) - whole(at - step)) / (2e-5 * at[i]), rel=1e-4, abs=1e-6)


def test_search_finds_the_lowest_point():
    seen = []

    def valley(p):
        seen.append(p)
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])
    at, value = L.minimise(valley, np.array([-1.2, 1.0]))
    assert at == pytest.approx([1, 1], abs=1e-4) and value < 1e-8 and len(seen) < 120
