"""Sampling, splitting and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import customers, features, sampling
from clientele.plans.oracle import CHURN, CLTV, LINES, METRICS, SCORES, SEGMENTS, TOTALS, with_
from clientele.plans.registry import query
from clientele.sources.tables import order_lines, table

# First recency day, share of quiet customers kept, recency day to stop before.
NOISE_ROUNDS = ((90, 0.9, None), (75, 0.75, 90), (60, 0.75, 75))


@query("sample_exact")
def sample_exact(spark, sf):
    """A fifth of the order lines, exactly."""
    return sampling.sample_exact(table(spark, sf, "lineitem"), frac=0.2, seed=10)


@query("undersample")
def undersample(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_totalprice") > 400000).cast("long").alias("label"))
    return sampling.undersample(o, "label", frac=0.2167, key=["order_id"])


@query("class_sizes", """
with t as (select (o_totalprice > 400000)::bigint as label from orders),
n as (select count(*) filter (label = 0) as zeros from t)
select label, count(*) as before,
       case when label = 1 then count(*) else round_even(0.2167 * (select zeros from n), 0)::bigint end as after
from t group by label""")
def class_sizes(spark, sf):
    """Rows per class before and after undersampling."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_totalprice") > 400000).cast("long").alias("label"))
    few = sampling.undersample(o, "label", frac=0.2167, key=["order_id"])
    before = o.groupBy("label").agg(F.count("*").alias("before"))
    return before.join(few.groupBy("label").agg(F.count("*").alias("after")), "label")


@query("fold_sizes", """
with t as (select (o_totalprice > 400000)::bigint as label, count(*) as n from orders group by 1)
select label, fold::bigint as fold, (n * (fold + 1)) // 5 - (n * fold) // 5 as n from t, range(0, 5) r(fold)""")
def fold_sizes(spark, sf):
    """Rows per class and fold."""
    return stratified_folds(spark, sf).groupBy("label", F.col("fold").cast("long").alias("fold")).agg(
        F.count("*").alias("n"))


@query("noise_sizes", with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS, CLTV, CHURN, """
bands as (select case when recency >= 90 then '90+' when recency >= 75 then '75-89'
                      when recency >= 60 then '60-74' end as band,
                 case when recency >= 90 then 0.9 else 0.75 end as keep, churn from churned)""") + """
select band, count(*) as quiet, count(*) - round_even(any_value(keep) * count(*), 0)::bigint as turned
from bands where band is not null and churn = 0 group by band""")
def noise_sizes(spark, sf):
    """Quiet customers per recency range, and how many of them the noise turned."""
    recency = F.col("recency")
    band = (F.when(recency >= 90, "90+").when(recency >= 75, "75-89").when(recency >= 60, "60-74"))
    per_customer = (label_noise(spark, sf).groupBy("customer_id", band.alias("band"))
                    .agg(F.max("before").alias("before"), F.max("churn").alias("churn")))
    return (per_customer.where("band is not null and before = 0").groupBy("band")
            .agg(F.count("*").alias("quiet"), F.sum("churn").alias("turned")))


@query("label_noise")
def label_noise(spark, sf):
    """Three rounds over falling recency; the rows show every line with its label before and after."""
    lines = customers.churn_lines(order_lines(spark, sf)).select(
        "customer_id", "order_id", "line_number", "recency", "churn")
    return sampling.label_noise(lines.withColumn("before", F.col("churn")), NOISE_ROUNDS)


@query("hash_split")
def hash_split(spark, sf):
    return sampling.hash_split(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"),
                                          F.col("o_custkey").alias("customer_id")),
        0.3, key=["customer_id"])


@query("stratified_folds")
def stratified_folds(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_totalprice") > 400000).cast("long").alias("label"))
    return sampling.stratified_folds(o, "label", 5, key=["order_id"])


@query("dummies", """
select o_orderkey as order_id, o_totalprice as total, (o_orderstatus = 'O')::bigint as status_O,
       (o_orderstatus = 'P')::bigint as status_P,
       (o_orderpriority = '2-HIGH')::bigint as "priority_2-HIGH",
       (o_orderpriority = '3-MEDIUM')::bigint as "priority_3-MEDIUM",
       (o_orderpriority = '4-NOT SPECIFIED')::bigint as "priority_4-NOT SPECIFIED",
       (o_orderpriority = '5-LOW')::bigint as "priority_5-LOW" from orders""")
def dummies(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return features.dummies(o, ["status", "priority"])


@query("robust_scale", """
with q as (select quantile_cont(o_totalprice, .25) as a, quantile_cont(o_totalprice, .5) as m,
                  quantile_cont(o_totalprice, .75) as b from orders)
select o_orderkey as order_id, round((o_totalprice - m) / (b - a), 6) as total from orders cross join q""")
def robust_scale(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))
    return features.robust_scale(o, ["total"]).withColumn("total", F.round("total", 6))


@query("minmax_scale", """
select c_custkey as customer_id, round((c_acctbal - (select min(c_acctbal) from customer))
  / ((select max(c_acctbal) from customer) - (select min(c_acctbal) from customer)), 6) as balance
from customer""")
def minmax_scale(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    return features.minmax_scale(c, ["balance"]).withColumn("balance", F.round("balance", 6))


@query("assemble_xy", """
select o_orderkey as order_id, (o_orderstatus = 'F')::int::double as label,
       o_custkey::double as x0, o_totalprice as x1 from orders""")
def assemble_xy(spark, sf):
    """Feature vector and label, without the columns the label was made from."""
    from pyspark.ml.functions import vector_to_array
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total"), F.lit(1).alias("recency"),
        (F.col("o_orderstatus") == "F").cast("long").alias("churn"))
    usable = [c for c in o.columns if c not in ("order_id", "churn", *features.LEAKING)]
    xy = features.assemble(o, usable, "churn", keep=["order_id"])
    x = vector_to_array("features")
    return xy.select("order_id", "label", x[0].alias("x0"), x[1].alias("x1"))
