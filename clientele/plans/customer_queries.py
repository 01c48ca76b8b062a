"""RFM, descriptive lifetime value, tenure and churn label."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clientele.operators import cleaning, customers, lifetime, profiling
from clientele.operators.joins import attach
from clientele.plans.oracle import CHURN, CLTV, LINES, METRICS, SCORES, SEGMENTS, TOTALS, with_
from clientele.plans.registry import query
from clientele.session import stage
from clientele.sources.tables import order_lines, purchases
from clientele.plans.oracle import PURCHASES

SCORED = with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS)
ALL = with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS, CLTV, CHURN)


@query("rfm_metrics", with_(LINES, TOTALS, METRICS) + """
select customer_id, recency, frequency, monetary from metrics""")
def rfm_metrics(spark, sf):
    return customers.rfm_metrics(order_lines(spark, sf))


@query("rfm_metrics_subday", with_(PURCHASES, TOTALS.replace("from lines", "from purchases"), METRICS) + """
select customer_id, recency, frequency, monetary from metrics where monetary > 0""")
def rfm_metrics_subday(spark, sf):
    return customers.rfm_metrics(purchases(spark, sf), positive_only=True)


@query("rfm_scores", SCORED + """
select customer_id, recency_score, frequency_score, monetary_score, rfm_score from segments""")
def rfm_scores(spark, sf):
    return customers.rfm_scores(customers.rfm_metrics(order_lines(spark, sf))).select(
        "customer_id", "recency_score", "frequency_score", "monetary_score", "rfm_score")


@query("rfm_segment", SCORED + """
select customer_id, recency, frequency, monetary, recency_score, frequency_score, monetary_score,
       rfm_score, segment from segments""")
def rfm_segment(spark, sf):
    return customers.rfm(order_lines(spark, sf))


@query("segment_profile", SCORED + """
select segment, round(avg(recency), 6) as recency_mean, count(recency) as recency_count,
       round(avg(frequency), 6) as frequency_mean, count(frequency) as frequency_count,
       round(avg(monetary), 4) as monetary_mean, count(monetary) as monetary_count
from segments group by segment""")
def segment_profile(spark, sf):
    p = customers.segment_profile(customers.rfm(order_lines(spark, sf)))
    return p.withColumns({"recency_mean": F.round("recency_mean", 6),
                          "frequency_mean": F.round("frequency_mean", 6),
                          "monetary_mean": F.round("monetary_mean", 4)})


@query("segment_members", SCORED + """
select customer_id from segments where segment = 'loyal_customers'""")
def segment_members(spark, sf):
    return customers.segment_members(customers.rfm(order_lines(spark, sf)), "loyal_customers")


@query("segment_sizes", SCORED + """
select segment, count(*) as n, round(100.0 * count(*) / (select count(*) from segments), 6) as ratio
from segments group by segment""")
def segment_sizes(spark, sf):
    return profiling.value_counts(customers.rfm(order_lines(spark, sf)), "segment").withColumn(
        "ratio", F.round("ratio", 6))


@query("rfm_lines", SCORED + """
select l.customer_id, order_id, line_number, value::double as value, recency, frequency,
       rfm_score, segment
from lines l left join segments s using (customer_id)""")
def rfm_lines(spark, sf):
    scored = customers.rfm(order_lines(spark, sf)).select(
        "customer_id", "recency", "frequency", "rfm_score", "segment")
    return order_lines(spark, sf, features=scored).select(
        "customer_id", "order_id", "line_number", F.col("value").cast("double").alias("value"),
        "recency", "frequency", "rfm_score", "segment")


@query("descriptive_cltv", with_(LINES, TOTALS, CLTV) + """
select customer_id, total_transaction, total_unit, total_price, round(avg_order_value, 6) as avg_order_value,
       round(purchase_frequency, 6) as purchase_frequency, round(profit_margin, 4) as profit_margin,
       round(customer_value, 3) as customer_value, round(cltv / 1e6, 3) as cltv_millions from cltv""")
def descriptive_cltv(spark, sf):
    return customers.descriptive_cltv(order_lines(spark, sf)).select(
        "customer_id", "total_transaction", "total_unit", "total_price",
        F.round("avg_order_value", 6).alias("avg_order_value"),
        F.round("purchase_frequency", 6).alias("purchase_frequency"),
        F.round("profit_margin", 4).alias("profit_margin"),
        F.round("customer_value", 3).alias("customer_value"),
        F.round(F.col("cltv") / 1e6, 3).alias("cltv_millions"))


@query("tenure", with_(LINES, TOTALS, METRICS) + """
select customer_id, tenure from metrics""")
def tenure(spark, sf):
    return customers.tenure(order_lines(spark, sf))


@query("churn_label", ALL + """
select l.customer_id, order_id, line_number, recency, tenure, rfm_score, segment, churn
from lines l left join churned using (customer_id)""")
def churn_label(spark, sf):
    feats = customers.customer_features(order_lines(spark, sf)).withColumn("churn", customers.churn_label())
    return order_lines(spark, sf, features=feats).select(
        "customer_id", "order_id", "line_number", "recency", "tenure", "rfm_score", "segment", "churn")


def _once(sql: str, *names: str) -> str:
    """The statement with some of its parts computed once."""
    for n in names:
        sql = sql.replace(f"{n} as (", f"{n} as materialized (")
    return sql


# Every customer counts as often as it has lines; a quantile between two positions is interpolated.
@query("churn_label_from_data", _once(with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS, CLTV), "lines", "totals").rstrip() + """,
feats as materialized (select s.*, c.cltv, n from segments s join cltv c using (customer_id)
  join (select customer_id, count(*) as n from lines group by 1) p using (customer_id)),
vals as (select 'c' as which, cltv as v, n from feats union all select 't', tenure::double, n from feats),
cum as (select which, v, sum(n) over (partition by which order by v rows unbounded preceding) as upto,
               (sum(n) over (partition by which) - 1) * .25 as h from vals where v is not null),
q as (select which, min(v) filter (upto > floor(h)) as lo, min(v) filter (upto > ceil(h)) as hi, any_value(h) as h
      from cum group by which),
lim as (select sum(cltv * n) / sum(n) filter (cltv is not null) as cm, sum(tenure * n) / sum(n) as tm,
               (select lo + (hi - lo) * (h - floor(h)) from q where which = 'c') as cq,
               (select lo + (hi - lo) * (h - floor(h)) from q where which = 't') as tq from feats),
flags as materialized (select customer_id,
  (coalesce(recency_score = 1, false)
   or coalesce(recency_score = 2 and frequency_score <= 2 and monetary_score <= 2
               and cltv <= cm and tenure <= tm, false)
   or coalesce(recency between 90 and 112 and frequency_score = 1 and monetary_score = 1
               and cltv <= cq and tenure <= tq, false))::bigint as churn from feats cross join lim)
select customer_id, order_id, line_number, churn from lines join flags using (customer_id)""")
def churn_label_from_data(spark, sf):
    lines = order_lines(spark, sf)
    featured = attach(lines.select("customer_id", "order_id", "line_number"),
                      customers.customer_features(lines), "customer_id", rows="n_lines")
    limits = customers.churn_limits_from(featured)
    return featured.select("customer_id", "order_id", "line_number",
                           customers.churn_label(limits).alias("churn"))


TRIMMED = with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS, CLTV, """
lim as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from (
  select quantile_cont(value::double, .4) as a, quantile_cont(value::double, .5) as b from lines)),
kept as (select lines.* from lines cross join lim where not (value::double < lo or value::double > hi)),
late as (select customer_id, floor((epoch_us((select max(order_ts) + interval 1 day from kept))
                                    - epoch_us(min(order_ts))) / 86400000000)::bigint as tenure
         from kept group by customer_id),
flags as (select s.customer_id, t.tenure,
    (coalesce(recency_score = 1, false)
     or coalesce(recency_score = 2 and frequency_score <= 2 and monetary_score <= 2
                 and cltv <= 5112 and t.tenure <= 555.38, false)
     or coalesce(recency between 90 and 112 and frequency_score = 1 and monetary_score = 1
                 and cltv <= 204.67 and t.tenure <= 442, false))::bigint as churn
  from segments s join cltv c using (customer_id) join late t using (customer_id))""")


@query("churn_label_trimmed", TRIMMED + """
select k.customer_id, order_id, line_number, value::double as value, tenure, churn
from kept k left join flags using (customer_id)""")
def churn_label_trimmed(spark, sf):
    """The staged flow: scores and value on all lines, then outlier trim, tenure and label."""
    lines = order_lines(spark, sf)
    limits = cleaning.outlier_limits(lines, ["value"], 0.40, 0.50)
    return customers.churn_lines(lines, trim=limits).select(
        "customer_id", "order_id", "line_number", F.col("value").cast("double").alias("value"),
        "tenure", "churn")


RETAIL = with_(LINES, """
cleaned as (select customer_id, invoice as order_id, order_ts, quantity, unit_price from lines
            where not contains(invoice, 'C') and quantity > 0 and unit_price > 0),
q as (select quantile_cont(quantity, .01) as q1, quantile_cont(quantity, .99) as q3,
             quantile_cont(unit_price, .01) as p1, quantile_cont(unit_price, .99) as p3 from cleaned),
capped as (select customer_id, order_id, order_ts,
  greatest(least(quantity, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) as quantity,
  greatest(least(unit_price, p3 + 1.5 * (p3 - p1)), p1 - 1.5 * (p3 - p1)) as unit_price from cleaned cross join q)""")


def _retail(spark, sf):
    lines = order_lines(spark, sf).select(
        "customer_id", F.col("invoice"), "order_ts", "quantity", "unit_price")
    # The limits read the lines several times: a written table, so that lines and orders meet once.
    clean = stage(cleaning.retail_clean(lines).drop("total_price"), "clean")
    capped = cleaning.winsorise(clean, cleaning.outlier_limits(clean, ["quantity", "unit_price"], 0.01, 0.99))
    return capped.withColumnRenamed("invoice", "order_id").withColumn(
        "value", F.col("quantity") * F.col("unit_price"))


@query("retail_rfm", RETAIL + """
select customer_id, floor((epoch_us(timestamp '2000-12-11') - epoch_us(max(order_ts))) / 86400000000)::bigint as recency,
       count(distinct order_id) as frequency, round(sum(quantity * unit_price), 3) as monetary
from capped group by customer_id""")
def retail_rfm(spark, sf):
    """Cleaned and capped invoice lines against a fixed day: later orders give negative recency."""
    return customers.rfm_metrics(_retail(spark, sf), datetime(2000, 12, 11), positive_only=True).withColumn(
        "monetary", F.round("monetary", 3))


@query("retail_lifetime", RETAIL + """
select customer_id, count(distinct order_id) as frequency,
  round(floor((epoch_us(max(order_ts)) - epoch_us(min(order_ts))) / 86400000000) / 7, 6) as recency,
  round(floor((epoch_us(timestamp '2001-12-11') - epoch_us(min(order_ts))) / 86400000000) / 7, 6) as age,
  round(sum(quantity * unit_price) / count(distinct order_id), 7) as monetary
from capped group by customer_id having count(distinct order_id) > 1""")
def retail_lifetime(spark, sf):
    out = lifetime.lifetime_summary(_retail(spark, sf), datetime(2001, 12, 11))
    return out.withColumns({"recency": F.round("recency", 6), "age": F.round("age", 6),
                            "monetary": F.round("monetary", 7)})
