"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.functions.scalars import money
from clientele.operators import customers, profiling
from clientele.operators.order_stats import exact_quantiles
from clientele.plans.oracle import CHURN, CLTV, LINES, METRICS, SCORES, SEGMENTS, TOTALS, with_
from clientele.plans.registry import query
from clientele.sources.tables import order_lines, table

ALL_SCORES = with_(LINES, TOTALS, METRICS, SCORES)


@query("group_sum_topk", """
select p_name as description, sum(l_quantity)::bigint as units
from lineitem join part on l_partkey = p_partkey group by p_name
order by units desc, description limit 10""")
def group_sum_topk(spark, sf):
    # Sum per part key before the join: the join then sees one row per part.
    per_part = (table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
                .agg(F.sum("l_quantity").alias("units")))
    named = per_part.join(table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("description")), "p_partkey")
    return (named.groupBy("description").agg(F.sum("units").cast("long").alias("units"))
            .orderBy(F.desc("units"), "description").limit(10))


@query("group_nunique", """
select o_custkey as customer_id, count(distinct o_orderdate) as order_days from orders group by 1""")
def group_nunique(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.countDistinct("o_orderdate").alias("order_days")))


@query("group_minmax", """
select user_id as customer_id, min(ts) as first_ts, max(ts) as last_ts, min(value) as lowest,
       max(value) as highest from events group by user_id""")
def group_minmax(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("customer_id")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("group_mean_count", """
select c_mktsegment as market_segment, count(c_acctbal) as balance_count,
       round(avg(c_acctbal), 6) as balance_mean,
       round(sum(c_acctbal::decimal(18,2))::double, 2) as balance_sum
from customer group by 1""")
def group_mean_count(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("market_segment"), money("c_acctbal").alias("balance"))
    return profiling.column_stats(c, "market_segment", ["balance"]).select(
        "market_segment", "balance_count", F.round(F.col("balance_mean").cast("double"), 6)
        .alias("balance_mean"), F.col("balance_sum").cast("double").alias("balance_sum"))


@query("two_level_agg", with_(LINES) + """
select customer_id, count(*) as frequency from (
  select customer_id, invoice, sum(value) as value from lines group by 1, 2) group by 1""")
def two_level_agg(spark, sf):
    per_invoice = order_lines(spark, sf).groupBy("customer_id", "invoice").agg(F.sum("value"))
    return per_invoice.groupBy("customer_id").agg(F.count("*").alias("frequency"))


@query("multi_key_mean", """
select o_orderstatus as order_status, o_orderpriority as order_priority,
       round(avg((o_totalprice > 250000)::int), 6) as target_mean from orders group by 1, 2""")
def multi_key_mean(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        (F.col("o_totalprice") > 250000).cast("int").alias("target"))
    return profiling.target_means(o, "target", ["order_status", "order_priority"]).withColumn(
        "target_mean", F.round("target_mean", 6))


@query("value_counts", """
select event_type, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 6) as ratio
from events where event_type is not null group by event_type""")
def value_counts(spark, sf):
    return profiling.value_counts(table(spark, sf, "events"), "event_type").withColumn(
        "ratio", F.round("ratio", 6))


@query("global_agg", """
select max(o_orderdate) as last_ts, min(o_orderdate) as first_ts, count(*) as n,
       count(distinct o_custkey) as n_customers, sum(o_totalprice::decimal(18,2))::double as total,
       round(avg(o_totalprice), 4) as mean_total from orders""")
def global_agg(spark, sf):
    return table(spark, sf, "orders").agg(
        F.max("o_orderdate").alias("last_ts"), F.min("o_orderdate").alias("first_ts"),
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"),
        F.sum(money("o_totalprice")).cast("double").alias("total"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_total"))


@query("band_bounds", ALL_SCORES + """
select recency_score, min(recency) as lowest, max(recency) as highest from scores group by 1""")
def band_bounds(spark, sf):
    scored = customers.rfm_scores(customers.rfm_metrics(order_lines(spark, sf)))
    return customers.score_bounds(scored, "recency_score", "recency")


@query("conditional_share", with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS, CLTV, CHURN) + """
select round(100.0 * sum(churn) / count(*), 6) as line_share,
       (select round(100.0 * sum(churn) / count(*), 6) from churned) as customer_share
from lines join churned using (customer_id)""")
def conditional_share(spark, sf):
    return customers.churn_shares(customers.churn_lines(order_lines(spark, sf))).select(
        F.round("line_share", 6).alias("line_share"),
        F.round("customer_share", 6).alias("customer_share"))


@query("quantiles", """
select p as p, round(l_price, 6) as extendedprice, round(l_qty, 6) as quantity from (
  select unnest([0, .05, .5, .95, .99, 1])::double as p,
    unnest(quantile_cont(l_extendedprice::double, [0, .05, .5, .95, .99, 1])) as l_price,
    unnest(quantile_cont(l_quantity::double, [0, .05, .5, .95, .99, 1])) as l_qty from lineitem)""")
def quantiles(spark, sf):
    probs = list(profiling.QUANTILES)
    got = exact_quantiles(table(spark, sf, "lineitem"), {
        "extendedprice": ("l_extendedprice", probs), "quantity": ("l_quantity", probs)})
    rows = list(zip(probs, got["extendedprice"], got["quantity"]))
    return spark.createDataFrame(rows, "p double, extendedprice double, quantity double").select(
        "p", F.round("extendedprice", 6).alias("extendedprice"), F.round("quantity", 6).alias("quantity"))


@query("corr_pairs", """
select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem
union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from lineitem
union all select 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) from lineitem
union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) from lineitem
union all select 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) from lineitem
union all select 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) from lineitem""")
def corr_pairs(spark, sf):
    return profiling.correlations(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ).select("a", "b", F.round("r", 6).alias("r"))


@query("pivot_mean", """
select o_orderpriority as order_priority,
       round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as F,
       round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as O,
       round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as P from orders group by 1""")
def pivot_mean(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "order_priority")
    return profiling.pivot_mean(o, "order_priority", "o_orderstatus", "o_totalprice",
                                ["F", "O", "P"]).select(
        "order_priority", *[F.round(s, 4).alias(s) for s in "FOP"])
