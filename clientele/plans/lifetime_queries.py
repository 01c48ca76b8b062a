"""Probabilistic lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import lifetime, profiling
from clientele.operators.lifetime import PurchaseModel, SpendModel
from clientele.plans.oracle import LINES, TOTALS, with_
from clientele.plans.registry import query
from clientele.session import stage
from clientele.sources.tables import order_lines

SUMMARY = """
as_of as (select max(last_ts) + interval 1 day as t from totals),
summary as (
  select customer_id, orders as frequency,
    floor((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000)::bigint / 7.0::double as recency,
    floor((epoch_us((select t from as_of)) - epoch_us(first_ts)) / 86400000000)::bigint / 7.0::double as age,
    spend / orders as monetary
  from totals where orders > 1 and spend / orders > 0)"""
SUMMARISED = with_(LINES, TOTALS, SUMMARY)

# Given parameters, so that the closed forms can be checked apart from the fit.
PURCHASE = PurchaseModel(r=0.9, alpha=30.0, a=0.6, b=2.5)
SPEND = SpendModel(p=6.25, q=3.74, gamma=15.44)
R, ALPHA, A, B = (f"{v}::double" for v in (PURCHASE.r, PURCHASE.alpha, PURCHASE.a, PURCHASE.b))
P, Q, GAMMA = (f"{v}::double" for v in (SPEND.p, SPEND.q, SPEND.gamma))

PROFIT = f"({GAMMA} + frequency * monetary) * {P} / ({P} * frequency + {Q} - 1)"


def expected_sql(t: str, terms: int = 400) -> str:
    """Expected purchases in t weeks; the hypergeometric series is summed term by term."""
    z = f"({t} / ({ALPHA} + age + {t}))"
    return f"""(({A} + {B} + frequency - 1) / ({A} - 1) * (1 - pow(({ALPHA} + age) / ({ALPHA} + age + {t}), {R} + frequency)
  * list_sum(list_transform(range(0, {terms}), lambda k: exp(
      lgamma({R} + frequency + k) - lgamma({R} + frequency) + lgamma({B} + frequency + k) - lgamma({B} + frequency)
      - lgamma({A} + {B} + frequency - 1 + k) + lgamma({A} + {B} + frequency - 1) - lgamma(k + 1.0) + k * ln{z}))))
  / (1 + {A} / ({B} + frequency - 1) * pow(({ALPHA} + age) / ({ALPHA} + recency), {R} + frequency)))"""


def _summary(spark, sf):
    return lifetime.lifetime_summary(order_lines(spark, sf))


@query("lifetime_summary", SUMMARISED + """
select customer_id, frequency, round(recency, 6) as recency, round(age, 6) as age,
       round(monetary, 7) as monetary from summary""")
def lifetime_summary(spark, sf):
    return _summary(spark, sf).withColumns({
        "recency": F.round("recency", 6), "age": F.round("age", 6), "monetary": F.round("monetary", 7)})


@query("bgnbd_loglik", SUMMARISED + f"""
select customer_id, round(
  lgamma({R} + frequency) - lgamma({R}) + {R} * ln({ALPHA})
  + lgamma({A} + {B}) + lgamma({B} + frequency) - lgamma({B}) - lgamma({A} + {B} + frequency)
  + ln(exp(-({R} + frequency) * ln({ALPHA} + age) + 60)
       + exp(ln({A}) - ln({B} + frequency - 1) - ({R} + frequency) * ln({ALPHA} + recency) + 60)) - 60, 6) as loglik
from summary""")
def bgnbd_loglik(spark, sf):
    v = [F.lit(p) for p in (PURCHASE.r, PURCHASE.alpha, PURCHASE.a, PURCHASE.b)]
    return _summary(spark, sf).select("customer_id", F.round(lifetime.bgnbd_loglik(
        F.col("frequency").cast("double"), F.col("recency"), F.col("age"), *v), 6).alias("loglik"))


@query("gg_loglik", SUMMARISED + f"""
select customer_id, round(lgamma({P} * frequency + {Q}) - lgamma({P} * frequency) - lgamma({Q}) + {Q} * ln({GAMMA})
  + ({P} * frequency - 1) * ln(monetary) + {P} * frequency * ln(frequency)
  - ({P} * frequency + {Q}) * ln(frequency * monetary + {GAMMA}), 6) as loglik from summary""")
def gg_loglik(spark, sf):
    v = [F.lit(p) for p in (SPEND.p, SPEND.q, SPEND.gamma)]
    return _summary(spark, sf).select("customer_id", F.round(lifetime.gg_loglik(
        F.col("frequency").cast("double"), F.col("monetary"), *v), 6).alias("loglik"))


@query("bgnbd_fit")
def bgnbd_fit(spark, sf):
    s = _summary(spark, sf)
    return lifetime.model_frame(s, lifetime.bgnbd_fit(s))


@query("gg_fit")
def gg_fit(spark, sf):
    s = _summary(spark, sf)
    return lifetime.model_frame(s, lifetime.gg_fit(s))


@query("fit_facts", SUMMARISED + """
select model, count(*) as n_customers, true as positive, true as nothing_near_is_better, true as likelihood_agrees
from summary, (values ('bgnbd'), ('gg')) m(model) where model = 'bgnbd' or frequency > 0 and monetary > 0 group by model""")
def fit_facts(spark, sf):
    """What must hold of both fits: no point one percent away has a penalised likelihood that is higher by
    more than a millionth."""
    s = stage(_summary(spark, sf), "summary")
    x, m, tx, age = (F.col(c).cast("double") for c in ("frequency", "monetary", "recency", "age"))
    spent = s.where("frequency > 0 and monetary > 0")
    cases = [("bgnbd", s, lifetime.bgnbd_fit(s), ("r", "alpha", "a", "b"), lifetime.BGNBD_PENALTY,
              lambda t: lifetime.bgnbd_loglik(x, tx, age, *t)),
             ("gg", spent, lifetime.gg_fit(s), ("p", "q", "gamma"), lifetime.GG_PENALTY, lambda t: lifetime.gg_loglik(x, m, *t))]
    rows = []
    for name, df, model, names, penalty, loglik in cases:
        best = [getattr(model, n) for n in names]
        points = [best] + [[v * (1 + 0.01 * side * (i == j)) for j, v in enumerate(best)]
                           for i in range(len(best)) for side in (1, -1)]
        got = df.agg(F.count("*"), *[F.sum(loglik([F.lit(v) for v in p])) for p in points]).first()
        n, values = got[0], got[1:]
        worth = [v / n - penalty * sum(t * t for t in p) for v, p in zip(values, points)]
        rows.append((name, n, min(best) > 0, worth[0] >= max(worth[1:]) - 1e-6 * abs(worth[0]),
                     abs(values[0] - model.log_likelihood) <= 1e-6 * abs(values[0])))
    return spark.createDataFrame(rows, "model string, n_customers long, positive boolean, "
                                       "nothing_near_is_better boolean, likelihood_agrees boolean")


HORIZONS = {"week": 1.0, "month": 4.0, "quarter": 12.0, "half_year": 24.0, "year": 48.0}


@query("bgnbd_expected", SUMMARISED + "select customer_id, " + ", ".join(
    f"round({expected_sql(f'{t}::double')}, 6) as {n}" for n, t in HORIZONS.items()) + " from summary")
def bgnbd_expected(spark, sf):
    out = lifetime.with_expected(_summary(spark, sf), PURCHASE, HORIZONS)
    return out.select("customer_id", *[F.round(n, 6).alias(n) for n in HORIZONS])


@query("expected_top", SUMMARISED + f"""
select customer_id, round({expected_sql("4.0::double")}, 6) as month from summary
order by month desc, customer_id limit 10""")
def expected_top(spark, sf):
    out = lifetime.with_expected(_summary(spark, sf), PURCHASE, {"month": 4.0})
    return (out.select("customer_id", F.round("month", 6).alias("month"))
            .orderBy(F.desc("month"), "customer_id").limit(10))


@query("expected_total", SUMMARISED + f"""
select count(*) as customers, round(sum({expected_sql("4.0::double")}), 4) as month,
       round(sum({expected_sql("12.0::double")}), 4) as quarter from summary""")
def expected_total(spark, sf):
    out = lifetime.with_expected(_summary(spark, sf), PURCHASE, {"month": 4.0, "quarter": 12.0})
    return out.agg(F.count("*").alias("customers"), F.round(F.sum("month"), 4).alias("month"),
                   F.round(F.sum("quarter"), 4).alias("quarter"))


@query("gg_profit", SUMMARISED + f"""
select customer_id, round({PROFIT}, 4) as expected_average_profit from summary""")
def gg_profit(spark, sf):
    return _summary(spark, sf).select("customer_id", F.round(
        lifetime.expected_profit(SPEND), 4).alias("expected_average_profit"))


def _clv_sql(months: int) -> str:
    w = lifetime.WEEKS_PER_MONTH
    parts = [f"({expected_sql(f'{i * w!r}::double')} - "
             f"{expected_sql(f'{(i - 1) * w!r}::double') if i > 1 else '0'}) / pow(1.01, {i})"
             for i in range(1, months + 1)]
    return f"{PROFIT} * ({' + '.join(parts)})"


@query("clv", SUMMARISED + f"""
select customer_id, round({_clv_sql(3)}, 3) as clv from summary""")
def clv(spark, sf):
    out = lifetime.with_clv(_summary(spark, sf), PURCHASE, SPEND, months=3)
    return out.select("customer_id", F.round("clv", 3).alias("clv"))


CLV_CTE = SUMMARISED.rstrip() + f""",
valued as (select *, {PROFIT} * frequency as clv from summary),
scaled as (select *, (clv - (select min(clv) from valued))
                     / ((select max(clv) from valued) - (select min(clv) from valued)) as scaled_clv from valued),
e as (select quantile_cont(scaled_clv, [.25,.5,.75]) as edges from scaled),
segmented as (select scaled.*, ['D','C','B','A'][1 + len(list_filter(edges, lambda z: scaled_clv > z))] as clv_segment
              from scaled cross join e)
"""


def _valued(spark, sf):
    # A value in closed form stands in for the fitted one, so the segments have an SQL check.
    summary = lifetime.lifetime_summary(order_lines(spark, sf), count_lines=True)
    return stage(summary.withColumn(
        "clv", lifetime.expected_profit(SPEND) * F.col("frequency")), "valued")


@query("clv_segments", CLV_CTE + """
select clv_segment, count(clv) as clv_count, round(avg(clv), 2) as clv_mean, round(sum(clv), 0) as clv_sum,
       count(frequency) as frequency_count, round(avg(frequency), 6) as frequency_mean,
       sum(frequency)::bigint as frequency_sum from segmented group by clv_segment""")
def clv_segments(spark, sf):
    p = profiling.column_stats(lifetime.clv_segments(_valued(spark, sf)), "clv_segment",
                               ["clv", "frequency"])
    return p.withColumns({"clv_mean": F.round("clv_mean", 2), "clv_sum": F.round("clv_sum", 0),
                          "frequency_mean": F.round("frequency_mean", 6)})


@query("clv_lines", CLV_CTE + """
select l.customer_id, l.order_id, l.line_number, round(scaled_clv, 6) as scaled_clv, clv_segment
from lines l left join segmented s using (customer_id)""")
def clv_lines(spark, sf):
    feats = lifetime.clv_segments(_valued(spark, sf)).select(
        "customer_id", F.round("scaled_clv", 6).alias("scaled_clv"), "clv_segment")
    return order_lines(spark, sf, features=feats).select(
        "customer_id", "order_id", "line_number", "scaled_clv", "clv_segment")


@query("backtest", CLV_CTE + """,
recent as (select customer_id, sum(value) as v from lines
           where order_ts > (select max(order_ts) - interval 90 day from lines) group by 1)
select sum(v)::double as revenue_all,
       (sum(v) filter (customer_id in (select customer_id from valued)))::double as revenue_valued,
       (select round(sum(clv), 0) from valued) as predicted from recent""".replace("\n,", ",", 1))
def backtest(spark, sf):
    out = lifetime.backtest(order_lines(spark, sf), _valued(spark, sf))
    return out.withColumn("predicted", F.round("predicted", 0))


MOST = 20
EVERYONE = with_(LINES, TOTALS, SUMMARY.replace("orders as frequency", "orders - 1 as frequency")
                 .replace("where orders > 1 and", "where"))
RISING = f"exp(lgamma({R} + x) - lgamma({R}) - lgamma(x + 1.0) + {R} * ln({ALPHA} / ({ALPHA} + t)) + x * ln(t / ({ALPHA} + t)))"
BETA = f"(lgamma({A}) + lgamma({B}) - lgamma({A} + {B}))"


@query("calibration", EVERYONE.rstrip() + f""",
ages as (select age as t, count(*) as n from summary group by age),
counted as (select t, n, x, {RISING} as c from ages, range(0, {MOST}) r(x)),
below as (select *, sum(c) over (partition by t order by x) - c as less from counted),
probs as (select n, x, exp(lgamma({A}) + lgamma({B} + x) - lgamma({A} + {B} + x) - {BETA}) * c
    + case when x > 0 then exp(lgamma({A} + 1) + lgamma({B} + x - 1) - lgamma({A} + {B} + x) - {BETA}) * (1 - less)
           else 0 end as p from below),
expected as (select x as purchases, sum(n * p) as expected from probs group by x),
whole as (select * from expected
          union all select {MOST}, (select count(*) from summary) - (select sum(expected) from expected)),
actual as (select least(frequency, {MOST}) as purchases, count(*) as actual from summary group by 1)
select w.purchases::bigint as purchases, coalesce(actual, 0) as actual, round(expected, 5) as expected
from whole w left join actual using (purchases)""")
def calibration(spark, sf):
    """Customers by number of repeat purchases, actual and expected under given parameters."""
    s = stage(lifetime.lifetime_summary(order_lines(spark, sf), repeat_only=True, more_than=0), "summary")
    return lifetime.calibration(s, PURCHASE, MOST).withColumn("expected", F.round("expected", 5))


@query("calibration_fitted")
def calibration_fitted(spark, sf):
    s = stage(lifetime.lifetime_summary(order_lines(spark, sf), repeat_only=True, more_than=0), "summary")
    return lifetime.calibration(s, lifetime.bgnbd_fit(s))


@query("clv_fitted")
def clv_fitted(spark, sf):
    """Both fits, six-month value, segments: the whole flow."""
    s = stage(_summary(spark, sf), "summary")
    valued = lifetime.with_clv(s, lifetime.bgnbd_fit(s), lifetime.gg_fit(s), months=6)
    return lifetime.clv_segments(stage(valued, "valued"))
