"""The plans have the shape that scales."""

import pytest

from clientele.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return all_queries()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rfm_segment", "rfm_lines", "churn_label", "rank_first", "qcut_rank",
                                  "scalar_broadcast", "winsorise", "clv_segments", "value_counts"])
def test_no_pairing_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bounds_and_columns_reach_the_scan(spark):
    text = plan(spark, "last_90_days")
    assert "GreaterThan(o_orderdate" in text and "o_totalprice" not in text


def test_scores_need_no_global_window(spark):
    assert "Window" not in plan(spark, "rfm_scores")


def test_totals_need_one_shuffle_after_the_join(spark):
    """Orders and lines meet by order; the sums per order then need no exchange of their own."""
    from clientele.operators.customers import customer_totals
    from clientele.sources.tables import order_lines
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = customer_totals(order_lines(spark, SF))
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text
    assert text.count("Exchange hashpartitioning(order_id") == 2
    assert text.count("Exchange hashpartitioning(customer_id") == 1
    assert text.count("Exchange") == 3


def test_scan_reads_only_needed_columns(spark):
    from clientele.operators.customers import customer_totals
    from clientele.sources.tables import order_lines
    text = customer_totals(order_lines(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in text and "l_discount" not in text and "l_shipdate" not in text


def test_customer_columns_meet_the_lines_through_the_orders(spark):
    """The lines are dealt out by order only, never by customer."""
    from clientele.sources.tables import order_lines
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feats = spark.range(100).selectExpr("id as customer_id", "id * 2 as f")
        df = order_lines(spark, SF, city=True, features=feats).select("line_number", "city", "f")
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange hashpartitioning(order_id") == 2
    assert "line_number" not in "".join(x for x in text.split("\n") if "hashpartitioning(customer_id" in x)
