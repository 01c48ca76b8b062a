from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientele.functions import scalars as S
from clientele.operators import cleaning, customers, features, joins, profiling

LINES = "customer_id long, order_id long, order_ts timestamp_ntz, value decimal(18,2), quantity double"


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


def test_null_keys_and_values(spark):
    t = datetime(2020, 1, 1)
    got = customers.rfm_metrics(lines(spark, [
        (1, 1, t, None, None), (1, 1, t, None, 1.0), (None, 2, t, Decimal(5), 1.0),
        (2, 3, datetime(2020, 1, 3), Decimal(7), 2.0)])).orderBy("customer_id").collect()
    assert [(r.customer_id, r.recency, r.frequency, r.monetary) for r in got] == [
        (1, 3, 1, 0.0), (2, 1, 1, 7.0)]


def test_empty_lines(spark):
    assert customers.rfm(lines(spark, [])).count() == 0
    assert customers.descriptive_cltv(lines(spark, [])).count() == 0


def test_no_one_order_customer_gives_null_value(spark):
    t = datetime(2020, 1, 1)
    got = customers.descriptive_cltv(lines(spark, [
        (1, 1, t, Decimal(5), 1.0), (1, 2, t, Decimal(5), 1.0)])).first()
    assert got.cltv is None and got.profit_margin == pytest.approx(3.8)


def test_day_diff_rounds_down(spark):
    at = datetime(2020, 3, 10, 12)
    cases = {datetime(2020, 3, 9, 12): 1, datetime(2020, 3, 9, 12, 0, 0, 1): 0,
             datetime(2020, 3, 10, 12, 0, 0, 1): -1, datetime(2020, 3, 11, 12): -1,
             datetime(2020, 3, 11, 12, 0, 0, 1): -2, at: 0, datetime(2019, 3, 10, 11): 366}
    df = spark.createDataFrame([(k,) for k in cases], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):  # 2020-03-08 has 23 hours there
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = df.select("t", S.day_diff(S.as_of_literal(at), "t").alias("d")).collect()
            assert {r.t: r.d for r in got} == cases
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_segment_of_every_score_pair(spark):
    pairs = spark.createDataFrame(
        [(r, f, f"{r}{f}") for r in range(1, 6) for f in range(1, 6)],
        "recency_score long, frequency_score long, rfm_score string")
    got = pairs.select(customers.rfm_segment().alias("a"), S.map_patterns(
        "rfm_score", customers.segment_patterns()).alias("b")).collect()
    assert len(got) == 25 and all(r.a == r.b and r.a for r in got)


@pytest.mark.parametrize("change,want", [
    ({}, 1), ({"cltv": 5112.01}, 0), ({"tenure": 556}, 0), ({"frequency_score": 3}, 0),
    ({"monetary_score": 3}, 0), ({"recency_score": 1, "cltv": None}, 1), ({"cltv": None}, 0),
    ({"recency_score": 3, "recency": 90, "frequency_score": 1, "monetary_score": 1, "cltv": 204.67,
      "tenure": 442}, 1),
    ({"recency_score": 3, "recency": 89, "frequency_score": 1, "monetary_score": 1, "cltv": 204.67,
      "tenure": 442}, 0),
    ({"recency_score": 3, "recency": 112, "frequency_score": 1, "monetary_score": 1, "cltv": 204.68,
      "tenure": 442}, 0)])
def test_churn_rules(spark, change, want):
    row = {"recency_score": 2, "recency": 200, "frequency_score": 2, "monetary_score": 2,
           "cltv": 5112.0, "tenure": 555, **change}
    df = spark.createDataFrame([tuple(row.values())],
                               "recency_score int, recency int, frequency_score int, "
                               "monetary_score int, cltv double, tenure int")
    assert df.select(customers.churn_label()).first()[0] == want


def test_attach_spreads_a_hot_key(spark):
    many = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.lit(0).alias("same"))
    feats = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("f", F.col("k") * 2)
    assert 1 in joins.heavy_keys(many, "k") and len(joins.heavy_keys(many, "k")) < 200
    for got in (joins.attach(many, feats.drop("n"), "k", task_rows=100), joins.attach(many, feats, "k", rows="n", task_rows=100)):
        assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.count() == 6000 and got.where("f = 2 * k").count() == 6000


def test_update_matching_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (None, 0)], "k long, x int")
    got = joins.update_matching(df, df.where("k = 1"), "k", "x", F.lit(1))
    assert sorted((r.k or 0, r.x) for r in got.collect()) == [(0, 0), (1, 1), (2, 0)]


def test_outliers(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 1000.0, None])],
                               "i long, x double")
    limits = cleaning.outlier_limits(df, ["x"], .25, .5)
    lo, hi = limits["x"]
    assert (lo, hi) == (0.5, 4.5)
    assert [r.x for r in cleaning.winsorise(df, limits).orderBy("i").collect()] == [1, 2, 3, 4, 4.5, None]
    assert cleaning.remove_outliers(df, limits).count() == 5  # the NULL stays
    assert cleaning.has_outlier(df, limits).first().has_outlier
    assert cleaning.row_loss(df, limits).first().removed == 1


def test_constant_columns_and_dummies(spark):
    df = spark.createDataFrame([(7.0, "a"), (7.0, "b"), (7.0, None)], "x double, c string")
    assert {r.x for r in features.minmax_scale(df, ["x"]).collect()} == {0.0}
    assert {r.x for r in features.robust_scale(df, ["x"]).collect()} == {0.0}
    assert sorted(r.c_b for r in features.dummies(df, ["c"]).collect()) == [0, 0, 1]


def test_ratios_bands_and_flags(spark):
    df = spark.createDataFrame([(x,) for x in (.1, .45, .5, .8, .9, 0., 1., None)], "p double")
    got = [(r.p, r.b, r.f) for r in df.select(
        "p", S.probability_band("p").alias("b"), S.threshold_flag("p").alias("f")).collect()]
    assert got == [(.1, "Low", 0), (.45, "Medium", 0), (.5, "Medium", 0), (.8, "High", 1),
                   (.9, "Very High", 1), (0., "Very_Low", 0), (1., "Very High", 1), (None, None, 0)]
    z = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in z.select(S.safe_ratio("a", "b")).collect()] == [None, None]


def test_profile_with_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (3.0, "c")], "x double, s string")
    d = profiling.describe(df, ["x"]).first()
    assert (d.n, d.mean, d.min, d.max, d.q50) == (2, 2.0, 1.0, 3.0, 2.0)
    miss = {r["column"]: (r.n_miss, r.ratio) for r in profiling.missing_values(df).collect()}
    assert miss == {"x": (2, 50.0), "s": (1, 25.0)}
    assert profiling.check_df(df).count() == 2


def test_frequent_keys_are_spread_by_their_rows(spark):
    lines = spark.range(20_000).selectExpr("if(id % 10 < 9, 1, id) as k", "id")
    feats = lines.select("k").distinct().selectExpr("k", "k * 2 as f")
    joined = joins.attach(lines, feats, "k", task_rows=1000)
    assert joined.count() == 20_000 and joined.where("f <> k * 2").count() == 0
    salts = joins.salts_of(joins.heavy_keys(lines, "k"), 1000)
    assert 18 <= salts[1] <= 20 and len(salts) == 1
