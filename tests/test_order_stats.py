import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.operators import order_stats as o

PROBS = [0, .05, .2, .5, .9, .99, 1]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    n = 4000
    v = np.where(rng.random(n) < .35, 7, rng.integers(0, 300, n)).astype(float)
    pdf = pd.DataFrame({"id": rng.permutation(n), "v": v, "f": rng.integers(1, 9, n),
                        "m": rng.normal(size=n).round(2)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("rows", [10**6, 40])
def test_quantiles_equal_pandas(sample, rows):
    pdf, df = sample
    got = o.exact_quantiles(df, {c: (c, PROBS) for c in pdf.columns}, rows)
    for c in pdf.columns:
        assert np.allclose(got[c], pdf[c].quantile(PROBS).values, rtol=0, atol=1e-9)


@pytest.mark.parametrize("rows", [10**6, 40])
def test_rank_bins_equal_qcut_of_rank(sample, rows):
    pdf, df = sample
    got = df.withColumn("b", o.rank_bin("f", "id", o.rank_cuts(df, "f", "id", 5, rows))).toPandas()
    by_id = pdf.sort_values("id").set_index("id")
    want = pd.qcut(by_id["f"].rank(method="first"), 5, labels=False) + 1
    assert (got.set_index("id")["b"].sort_index().values == want.values).all()


@pytest.mark.parametrize("rows", [10**6, 40])
def test_rank_first_with_a_hot_value(sample, rows):
    _, df = sample
    got = o.rank_first(df, "v", "id", "rk", rows).toPandas().sort_values(["v", "id"])
    assert (got["rk"].values == np.arange(1, len(got) + 1)).all()


def test_rank_first_uses_many_tasks(sample):
    _, df = sample
    split = o.range_split(df, "v", "id", 40)
    sizes = split.groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert sizes < 400  # the hot value alone has 1400 rows


@pytest.mark.parametrize("rows", [10**6, 40])
def test_running_totals(sample, rows):
    _, df = sample
    table = df.groupBy("v").agg(F.count("*").alias("n"))
    got = o.running_totals(table, "v", ["n"], rows).toPandas().sort_values("v")
    assert (got["below_n"].values == got["n"].cumsum().shift(1, fill_value=0).values).all()


def test_qcut_random_frames_equal_pandas(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        values = rng.normal(size=int(rng.integers(20, 90))).round(1)
        pdf = pd.DataFrame({"i": range(len(values)), "x": values})
        pdf.loc[rng.integers(0, len(pdf), 3), "x"] = np.nan
        want = pd.qcut(pdf["x"], 4, labels=False, duplicates="drop")
        df = spark.createDataFrame(pdf)
        got = o.qcut(df, "x", 4, "b", duplicates="drop").orderBy("i").toPandas()["b"]
        assert ((got - 1).fillna(-1).values == want.fillna(-1).values).all()


def test_duplicate_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1] * 10 + [2, 3, 4, 5, 6]], "x double")
    with pytest.raises(ValueError, match="not unique"):
        o.qcut(df, "x", 5, "b")
    assert o.qcut(df, "x", 5, "b", duplicates="drop").where("b is null").count() == 0


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "x double")
    assert o.exact_quantiles(empty, {"x": ("x", [.5])}) == {"x": [None]}
    assert o.qcut(empty, "x", 4, "b").count() == 0
    one = spark.createDataFrame([(3.0,)], "x double")
    assert o.exact_quantiles(one, {"x": ("x", [0, .5, 1])}) == {"x": [3.0, 3.0, 3.0]}


def test_long_values_beyond_double_precision(spark):
    big = (1 << 60) + 1
    values = [big] * 600 + [big + i for i in range(1, 300)] + [-(1 << 62) - 3] * 200
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    n, got = o.select_positions(df, {"v": "v"}, lambda _, n: [1, 200, 201, 800, 801, 900, n], task_rows=30)
    ranked = sorted(values)
    assert n["v"] == len(values)
    assert {p: s.value for p, s in got["v"].items()} == {p: ranked[p - 1] for p in (1, 200, 201, 800, 801, 900, len(values))}


@pytest.mark.parametrize("rows", [10**6, 37])
def test_rank_of_large_longs_text_keys_and_hot_values(spark, rows):
    rng = np.random.default_rng(8)
    big = (1 << 60) + 1
    values = [big] * 500 + [big + int(i) for i in rng.integers(0, 5, 300)] + [-big, -big - 1, 3] * 40
    keys = [f"k{'0' * int(i % 3)}{i}" for i in rng.permutation(len(values))]
    clustered = sorted(zip(values, keys))
    df = spark.createDataFrame([*zip(values, keys), (None, "gone")], "v long, k string").repartition(5)
    got = o.rank_first(df, "v", "k", "r", rows).orderBy("r").collect()
    assert [(r.v, r.k, r.r) for r in got] == [(*x, i) for i, x in enumerate(clustered, 1)]


def test_a_hot_value_is_cut_by_its_own_keys(spark):
    """Keys of the hot value lie close together among far-away keys of the others."""
    df = spark.range(4000).selectExpr("if(id < 3000, 7, id) as v", "if(id < 3000, id, id * 1000000000) as k")
    sizes = [r["n"] for r in o.range_split(df, "v", "k", 500).groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000
