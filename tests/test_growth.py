"""Steps that once read or computed more than their result needs."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_retail_lines_and_orders_meet_once(spark):
    """the limits and the sums read a written table, not the join."""
    from clientele.plans.customer_queries import _retail
    text = _retail(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "l_orderkey" not in text


def test_class_sizes_encode_nothing(spark, monkeypatch):
    """F16: counts of the frame's rows need no features."""
    from clientele.plans import churn_model, model_queries
    monkeypatch.setattr(churn_model, "model_frame", None)
    rows = {r["label"]: r for r in model_queries.model_class_sizes(spark, SF).collect()}
    assert rows[1]["before"] == rows[1]["after"] and rows[0]["after"] == round((1 - model_queries.DROPPED_SHARE) * rows[0]["before"])


def test_rounds_use_every_core(spark, monkeypatch):
    """the points of a round lie in as many files as tasks are worth while."""
    from clientele.operators import clusters
    one = spark.range(100_000).select((F.col("id") % 997).cast("double").alias("recency"),
                                      (F.col("id") % 7).cast("double").alias("frequency"),
                                      (F.col("id") % 89).cast("double").alias("monetary")).coalesce(1)
    passes = []
    real = clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda data, models: passes.append(data) or real(data, models))
    fitted = clusters.fit_clusters(clusters.scaled_features(one), [3], starts=2)
    assert all(len(data.inputFiles()) == 5 for data in passes) and fitted[3].cost > 0
