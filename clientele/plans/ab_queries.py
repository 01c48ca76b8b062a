"""A/B tests on the campaign table and on the event values of the two groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.functions.scalars import safe_ratio
from clientele.operators import abtest
from clientele.plans.oracle import CAMPAIGN, with_, sql_inverse_normal
from clientele.plans.registry import query
from clientele.session import stage
from clientele.sources.tables import campaign, table

GROUPS = ("control", "test")
EVENTS = """
samples as (select case when user_id % 2 = 0 then 'control' else 'test' end as type, value as v from events)"""


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "control").otherwise("test").alias("type"), "value")


@query("ab_group_stats", with_(CAMPAIGN) + """
select type, round(avg(impression), 6) as impression_mean, round(avg(click), 6) as click_mean,
       round(avg(purchase), 6) as purchase_mean, round(sum(earning), 2) as earning_sum,
       sum(purchase) as purchase_sum, round(avg(earning / nullif(purchase, 0)), 6) as earning_per_purchase,
       round(avg(click / nullif(impression, 0)), 6) as click_rate
from campaign group by type""")
def ab_group_stats(spark, sf):
    c = campaign(spark, sf)
    sums = abtest.group_stats(c, "type", ["impression", "click", "purchase", "earning"])
    ratios = (c.withColumn("epp", safe_ratio("earning", "purchase"))
              .withColumn("rate", safe_ratio("click", "impression")).groupBy("type").agg(
        F.round(F.avg("epp"), 6).alias("earning_per_purchase"), F.round(F.avg("rate"), 6).alias("click_rate")))
    return sums.join(ratios, "type").select(
        "type", *[F.round(f"{m}_mean", 6).alias(f"{m}_mean") for m in ("impression", "click", "purchase")],
        F.round("earning_sum", 2).alias("earning_sum"), "purchase_sum", "earning_per_purchase", "click_rate")


@query("shapiro")
def shapiro(spark, sf):
    """Both groups' event values, and daily purchases."""
    rows = []
    for name, df, column in (("event value", _events(spark, sf), "value"),
                             ("daily purchases", campaign(spark, sf), "purchase")):
        for g in GROUPS:
            n, w, p = abtest.shapiro(df.where(F.col("type") == g), column)
            rows.append((name, g, n, w, p, n <= abtest.SHAPIRO_TESTED_N))
    return spark.createDataFrame(
        rows, "metric string, type string, n long, statistic double, p double, p_in_tested_range boolean")


_U = "((k - 0.375) / (n + 0.25))"


@query("shapiro_w", with_(EVENTS, f"""
ranked as (select type, v, row_number() over (partition by type order by v) as k,
                  (count(*) over (partition by type))::double as n from samples),
scored as (select *, {sql_inverse_normal(_U)} as m from ranked),
sums as (select type, n, sum(m * m) as total, sum(v * m) as weighted, var_samp(v) * (n - 1) as spread,
                max(m) as m1, max(m) filter (k = n - 1) as m2, max(v) - min(v) as outer_,
                max(v) filter (k = n - 1) - max(v) filter (k = 2) as inner_, 1 / sqrt(n) as u
         from scored group by type, n),
ends as (select *,
  m1 / sqrt(total) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 as a1,
  m2 / sqrt(total) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 as a2
  from sums)""") + """
select type, n::bigint as n, round(pow((weighted - m1 * outer_ - m2 * inner_)
    / sqrt((total - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * outer_ + a2 * inner_, 2)
    / spread, 6) as statistic
from ends""")
def shapiro_w(spark, sf):
    """The W statistic of both groups' event values."""
    rows = [(g, *abtest.shapiro(_events(spark, sf).where(F.col("type") == g), "value")[:2]) for g in GROUPS]
    return spark.createDataFrame(rows, "type string, n long, statistic double").withColumn(
        "statistic", F.round("statistic", 6))


@query("levene", with_(EVENTS, """
med as (select type, quantile_cont(v, .5) as med from samples group by type),
z as (select type, abs(v - med) as z from samples join med using (type)),
g as (select type, count(*) as n, avg(z) as m, var_samp(z) as s from z group by type)""") + """
select round((sum(n) - 2) * sum(n * pow(m - (select avg(z) from z), 2)) / sum((n - 1) * s), 6) as statistic
from g""")
def levene(spark, sf):
    f, _ = abtest.levene(_events(spark, sf), "type", "value", GROUPS)
    return spark.createDataFrame([(f,)], "statistic double").select(F.round("statistic", 6).alias("statistic"))


@query("t_test", with_(EVENTS, """
g as (select count(v) filter (type = 'control') as n1, count(v) filter (type = 'test') as n2,
  avg(v) filter (type = 'control') as m1, avg(v) filter (type = 'test') as m2,
  var_samp(v) filter (type = 'control') as s1, var_samp(v) filter (type = 'test') as s2 from samples)""") + """
select round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0::double / n1 + 1.0::double / n2)), 6) as statistic
from g""")
def t_test(spark, sf):
    t, _ = abtest.t_test(_events(spark, sf), "type", "value", GROUPS)
    return spark.createDataFrame([(t,)], "statistic double").select(F.round("statistic", 6).alias("statistic"))


@query("prop_z", with_(CAMPAIGN, """
s as (select sum(click) filter (type = 'control') as c1, sum(click) filter (type = 'test') as c2,
  sum(impression) filter (type = 'control') as t1, sum(impression) filter (type = 'test') as t2 from campaign)""") + """
select round((c1 / t1 - c2 / t2) / sqrt((c1 + c2) / (t1 + t2) * (1 - (c1 + c2) / (t1 + t2)) * (1 / t1 + 1 / t2)), 6) as z
from s""")
def prop_z(spark, sf):
    z, _ = abtest.proportions_test(campaign(spark, sf), "type", "click", "impression", GROUPS)
    return spark.createDataFrame([(z,)], "z double").select(F.round("z", 6).alias("z"))


@query("mann_whitney", with_(EVENTS, """
r as (select type, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double as rk from samples),
t as (select sum(c * c * c - c) as ties from (select count(*)::double as c from samples group by v)),
u as (select sum(rk) filter (type = 'control') as r1, count(*) filter (type = 'control')::double as a,
             count(*) filter (type = 'test')::double as b from r)""") + """
select round(r1 - a * (a + 1) / 2, 1) as u, round(
  sign(r1 - a * (a + 1) / 2 - a * b / 2) * greatest(abs(r1 - a * (a + 1) / 2 - a * b / 2) - 0.5, 0)
  / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))), 6) as z from u cross join t""")
def mann_whitney(spark, sf):
    u, z, _ = abtest.mann_whitney(_events(spark, sf), "type", "value", GROUPS)
    return spark.createDataFrame([(u, z)], "u double, z double").select(
        F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


@query("ab_test")
def ab_test(spark, sf):
    daily = stage(campaign(spark, sf), "campaign")
    out = abtest.ab_test(daily, "type", ["impression", "click", "purchase", "earning"], GROUPS)
    return out.unionByName(abtest.ab_test(_events(spark, sf), "type", ["value"], GROUPS))
