import pytest
from pyspark.sql import functions as F

from clientele.operators import sampling


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [10**6, 30])
def test_exact_size_whatever_the_partitions(spark, limit):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    one = sampling.sample_exact(a.repartition(3), n=137, task_rows=limit)
    two = sampling.sample_exact(a.repartition(11), n=137, task_rows=limit)
    assert one.count() == 137 and rows(one) == rows(two)
    assert sampling.sample_exact(a, frac=0.25).count() == 250
    assert sampling.sample_exact(a, n=0).count() == 0 and sampling.sample_exact(a, n=5000).count() == 1000


def test_copies_and_shared_keys(spark):
    copies = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("v"))
    for n in (1, 250, 599, 700):
        assert sampling.sample_exact(copies, n=n).count() == n
    keyed = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    got = sampling.sample_exact(keyed, n=50, key=["k"])
    assert got.count() == 50 and got.distinct().count() == 50


def test_undersample(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in sampling.undersample(df, "y", n=200).groupBy("y").count().collect()}
    assert got == {0: 200, 1: 100}


def test_folds_are_balanced_per_class(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    folds = sampling.stratified_folds(df.repartition(4), "y", 5)
    sizes = folds.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in sizes if r.y == y]
        assert len(c) == 5 and max(c) - min(c) <= 1
    again = sampling.stratified_folds(df.repartition(9), "y", 5)
    assert rows(folds) == rows(again)


def test_split_keeps_groups_together(spark):
    df = spark.range(5000).select("id", (F.col("id") % 400).alias("c"))
    got = sampling.hash_split(df, 0.3, key=["c"])
    assert got.groupBy("c").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0
    share = got.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.2 < share < 0.4


def test_label_noise_counts(spark):
    # 100 customers, two lines each; recency is the customer number, none churned
    df = spark.range(200).select((F.col("id") % 100).alias("customer_id"),
                                 (F.col("id") % 100).alias("recency"), F.lit(0).alias("churn"))
    got = sampling.label_noise(df, [(90, 0.9, None), (75, 0.8, 90)])
    turned = got.where("churn = 1")
    assert got.count() == 200
    assert turned.where("recency >= 90").count() == 2 * 1
    assert turned.where("recency >= 75 and recency < 90").count() == 2 * 3
    assert turned.where("recency < 75").count() == 0
