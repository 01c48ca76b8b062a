"""Canonical views over the input tables.

Joins are only made for the columns asked for: a plain left-over join is not removed by the
optimizer, and each one is a shuffle of the order lines at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.functions.scalars import money
from clientele.operators.joins import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, city: bool = False,
                product: bool = False, features: DataFrame | None = None) -> DataFrame:
    """One row per product on an order.

    ``city`` adds the customer's place and market segment, ``product`` the part's name and brand,
    ``features`` the columns of a table with a row per customer. What belongs to customers is joined to the
    orders, which then meet the lines by order: the lines move once, and not by customer.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_ts"), F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        money("l_extendedprice").alias("value"), F.col("l_tax").alias("tax_ratio"),
        F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("ship_ts"))
    if city:
        c = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("n_nationkey"),
            F.col("c_mktsegment").alias("market_segment"))
        n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
        # Nations are a fixed list of 25, whatever the size of the rest.
        o = o.join(c.join(F.broadcast(n), "n_nationkey").drop("n_nationkey"), "customer_id")
    if features is not None:
        o = attach(o, features, "customer_id")
    lines = li.join(o, "order_id").withColumn("invoice", F.concat(
        F.when(F.col("return_flag") == "R", "C").otherwise(""), F.col("order_id").cast("string")))
    if product:
        p = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("description"),
            F.col("p_brand").alias("brand"))
        lines = lines.join(p, "product_id")
    return lines


def orders_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers with the columns of an order line, one row per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_ts"), money("o_totalprice").alias("value"),
        F.lit(1.0).alias("quantity"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as order lines; their times are not at midnight."""
    return (table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
            .select(F.col("user_id").alias("customer_id"), F.col("event_id").alias("order_id"),
                    F.col("ts").alias("order_ts"), money("value").alias("value"),
                    F.lit(1.0).alias("quantity")))


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day and group: impressions, clicks, purchases, earnings."""
    kind = F.col("event_type")
    return (table(spark, sf_dir, "events")
            .groupBy(F.to_date("ts").alias("day"),
                     F.when(F.col("user_id") % 2 == 0, "control").otherwise("test").alias("type"))
            .agg(F.count_if(kind == "view").cast("double").alias("impression"),
                 F.count_if(kind == "click").cast("double").alias("click"),
                 F.count_if(kind == "purchase").cast("double").alias("purchase"),
                 F.coalesce(F.sum(F.when(kind == "purchase", money("value"))),
                            F.lit(0)).cast("double").alias("earning")))
