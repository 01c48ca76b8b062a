import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions import special
from clientele.operators import abtest as A


def test_published_tails():
    assert special.p_two_sided_t(-0.9416, 78) == pytest.approx(.3493, abs=5e-5)
    assert special.p_upper_f(2.6393, 1, 78) == pytest.approx(.1083, abs=5e-5)
    assert A.shapiro_p(.9773, 40) == pytest.approx(.5891, abs=2e-3)
    assert A.shapiro_p(.9589, 40) == pytest.approx(.1541, abs=2e-3)
    assert special.p_two_sided_z(27.2908) == pytest.approx(0, abs=1e-12)


def test_beta_inc_closed_forms():
    assert special.beta_inc(1, 3, .2) == pytest.approx(1 - .8**3)
    assert special.beta_inc(2.5, 2.5, .5) == pytest.approx(.5)


def test_shapiro_known_sample(spark):
    # Normal quantiles are as normal as a sample can be; their exponentials are not.
    z = [NormalDist().inv_cdf((i + .5) / 200) for i in range(200)]
    df = spark.createDataFrame([(x, math.exp(x)) for x in z], "a double, b double")
    n, w, p = A.shapiro(df, "a")
    assert n == 200 and w > .99 and p > .9
    _, w2, p2 = A.shapiro(df, "b")
    assert w2 < .8 and p2 < 1e-6


def test_shapiro_with_ties_equals_the_formula(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.sort(rng.exponential(size=400).round(1))
    m = np.array([NormalDist().inv_cdf((i - .375) / 400.25) for i in range(1, 401)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    want = A._shapiro_w(400, (x[0], x[1], x[-2], x[-1]), float((x * m).sum()), float(((x - x.mean())**2).sum()),
                        float((m * m).sum()))
    for run in (A.SCORE_RUN, 7):
        monkeypatch.setattr(A, "SCORE_RUN", run)
        n, w, _ = A.shapiro(df, "v")
        assert n == 400 and w == pytest.approx(want, abs=1e-9)
    assert A.shapiro(df.where("v < 0"), "v") == (0, None, None)


def test_inverse_normal(spark):
    u = [1e-300, 1e-20, 1e-9, .01, .074, .075, .3, .5, .7, .925, .926, .99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in u], "u double").coalesce(1).select(
        special.inverse_normal(F.col("u"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in u], rel=1e-12, abs=1e-15)


def test_tests_on_small_groups(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 9.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    t, p = A.t_test(df, "g", "v", ("a", "b"))
    pooled = (np.var(a, ddof=1) + np.var(b, ddof=1)) / 2  # equal group sizes
    assert t == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(pooled * 2 / 4))
    u, z, _ = A.mann_whitney(df, "g", "v", ("a", "b"))
    pairs = sum((x > y) + .5 * (x == y) for x in a for y in b)
    assert u == pairs and z < 0
    f, _ = A.levene(df, "g", "v", ("a", "b"))
    da, db = np.abs(np.array(a) - 2.5), np.abs(np.array(b) - 5.0)
    m = np.concatenate([da, db]).mean()
    want = 6 * (4 * (da.mean() - m)**2 + 4 * (db.mean() - m)**2) / (
        ((da - da.mean())**2).sum() + ((db - db.mean())**2).sum())
    assert f == pytest.approx(want)
    assert A.t_test(df.where("g = 'a'"), "g", "v", ("a", "b")) == (None, None)


def test_proportions():
    z, _ = A.proportions_z(30, 100, 45, 120)
    p = 75 / 220
    assert z == pytest.approx((.3 - .375) / math.sqrt(p * (1 - p) * (1 / 100 + 1 / 120)))
    assert A.proportions_z(5, 2, 5, 2) == (None, None)


def test_tails_with_very_many_degrees_of_freedom():
    for df in (1e8, 1e10, 1e12, 1e15):
        assert special.p_two_sided_t(1.0, df) == pytest.approx(special.p_two_sided_z(1.0), rel=1e-6)
