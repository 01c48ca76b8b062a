import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions.special import hyp2f1, ln_gamma
from clientele.operators import lifetime as L


def test_ln_gamma(spark):
    xs = [1e-3, .1, .5, 1., 2., 7.3, 50., 1000., 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in df.select("x", ln_gamma(F.col("x"))).collect():
        assert got == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)


def test_hyp2f1_closed_forms():
    z = np.array([0.0, .3, .9])
    assert hyp2f1(1, 1, 2, z[1:]) == pytest.approx(-np.log1p(-z[1:]) / z[1:])
    assert hyp2f1(2.5, 3.0, 3.0, z) == pytest.approx((1 - z) ** -2.5)


@pytest.fixture(scope="module")
def drawn(spark):
    """4000 customers drawn from known BG/NBD and Gamma-Gamma parameters."""
    rng = np.random.default_rng(5)
    r, alpha, a, b = 1.2, 6.0, 0.8, 2.5
    p, q, gamma = 6.0, 4.0, 15.0
    rows = []
    for i in range(4000):
        lam, drop, age = rng.gamma(r, 1 / alpha), rng.beta(a, b), float(rng.integers(30, 80))
        t = x = last = 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < drop:
                break
        nu = rng.gamma(q, 1 / gamma)
        m = float(rng.gamma(p, 1 / nu, int(x)).mean()) if x else None
        rows.append((i, int(x), last, age, m))
    return spark.createDataFrame(
        rows, "customer_id long, frequency long, recency double, age double, monetary double").cache()


def test_parameters_are_recovered(drawn):
    m = L.bgnbd_fit(drawn, penalty=0.0)
    assert m.r == pytest.approx(1.2, rel=.15) and m.alpha == pytest.approx(6.0, rel=.2)
    assert m.a / (m.a + m.b) == pytest.approx(0.8 / 3.3, rel=.15)
    s = L.gg_fit(drawn, penalty=0.0)
    assert s.p * s.gamma / (s.q - 1) == pytest.approx(6 * 15 / 3, rel=.1)


def test_expected_purchases_properties():
    m = L.PurchaseModel(.9, 12., .7, 2.1)
    x, tx, age = np.array([0., 1, 5, 30]), np.array([0., 3, 20, 39]), np.full(4, 40.)
    steps = [L.expected_purchases(m, x, tx, age, t) for t in (0.0, 1.0, 5.0, 30.0)]
    assert np.allclose(steps[0], 0)
    assert all((b > a).all() for a, b in zip(steps, steps[1:]))
    near = L.PurchaseModel(.9, 12., 1.0, 2.1)
    left = L.PurchaseModel(.9, 12., 1.0 - 1e-5, 2.1)
    assert L.expected_purchases(near, x, tx, age, 4.) == pytest.approx(
        L.expected_purchases(left, x, tx, age, 4.), rel=1e-3)


def test_purchase_probabilities_sum_to_one():
    p = L.purchase_probabilities(L.PurchaseModel(.9, 12., .7, 2.1), 30.0, 400)
    assert (p >= 0).all() and p.sum() == pytest.approx(1.0, abs=1e-6)


def test_calibration_counts_everyone(drawn):
    got = L.calibration(drawn, L.PurchaseModel(1.2, 6.0, .8, 2.5), 10).toPandas().sort_values("purchases")
    assert got["actual"].sum() == 4000 and got["expected"].sum() == pytest.approx(4000)
    # the drawing stops at a drop-out after a purchase, as the model says
    assert np.abs(got["actual"] - got["expected"]).max() < 120


def test_clv_discounting(spark):
    s = spark.createDataFrame([(1, 5, 20.0, 30.0, 10.0)],
                              "customer_id long, frequency long, recency double, age double, monetary double")
    m, g = L.PurchaseModel(.9, 12., .7, 2.1), L.SpendModel(6.0, 4.0, 15.0)
    none = L.with_clv(s, m, g, months=3, discount=0.0).first().clv
    e = L.with_expected(s, m, {"e": 3 * L.WEEKS_PER_MONTH}).first().e
    profit = s.select(L.expected_profit(g)).first()[0]
    assert none == pytest.approx(e * profit)
    assert L.with_clv(s, m, g, months=3).first().clv < none


def test_hyp2f1_near_one():
    assert hyp2f1(1, 1, 2, 0.9999) == pytest.approx(-np.log1p(-0.9999) / 0.9999, rel=1e-9)
    with pytest.raises(ArithmeticError):
        hyp2f1(1, 1, 2, np.array([0.5, 0.9999]), max_terms=200)
