"""SQL fragments (DuckDB dialect) that the oracle statements share."""

from clientele.functions.special import NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL

LINES = """
lines as (
  select o_custkey as customer_id, o_orderkey as order_id, o_orderdate as order_ts,
         o_orderstatus as order_status, o_orderpriority as order_priority,
         l_partkey as product_id, l_linenumber::bigint as line_number, l_quantity as quantity,
         l_extendedprice / l_quantity as unit_price, l_extendedprice::decimal(18,2) as value,
         l_tax as tax_ratio, l_discount as discount, l_returnflag as return_flag,
         l_linestatus as line_status, l_shipdate as ship_ts,
         concat(case when l_returnflag = 'R' then 'C' else '' end, o_orderkey) as invoice,
         n_name as city, c_mktsegment as market_segment
  from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

TOTALS = """
totals as (
  select customer_id, count(distinct order_id) as orders, sum(value)::double as spend,
         sum(quantity)::double as units, min(order_ts) as first_ts, max(order_ts) as last_ts
  from lines group by customer_id)"""

METRICS = """
as_of as (select max(last_ts) + interval 1 day as t from totals),
metrics as (
  select customer_id,
         floor((epoch_us((select t from as_of)) - epoch_us(last_ts)) / 86400000000)::bigint as recency,
         orders as frequency, spend as monetary,
         floor((epoch_us((select t from as_of)) - epoch_us(first_ts)) / 86400000000)::bigint as tenure
  from totals)"""

SCORES = """
edges as (
  select quantile_cont(recency::double, [.2,.4,.6,.8]) as er,
         quantile_cont(monetary::double, [.2,.4,.6,.8]) as em, count(*) as n from metrics),
ranked as (select *, row_number() over (order by frequency, customer_id) as rk from metrics),
scores as (
  select customer_id, recency, frequency, monetary, tenure,
         (5 - len(list_filter(er, lambda z: recency > z)))::bigint as recency_score,
         (1 + (rk > 1 + (n-1)*.2)::int + (rk > 1 + (n-1)*.4)::int + (rk > 1 + (n-1)*.6)::int
            + (rk > 1 + (n-1)*.8)::int)::bigint as frequency_score,
         (1 + len(list_filter(em, lambda z: monetary > z)))::bigint as monetary_score
  from ranked cross join edges)"""

SEGMENTS = """
segments as (
  select *, concat(recency_score, frequency_score) as rfm_score,
    case when recency_score <= 2 and frequency_score <= 2 then 'hibernating'
         when recency_score <= 2 and frequency_score <= 4 then 'at_Risk'
         when recency_score <= 2 then 'cant_loose'
         when recency_score = 3 and frequency_score <= 2 then 'about_to_sleep'
         when recency_score = 3 and frequency_score = 3 then 'need_attention'
         when recency_score <= 4 and frequency_score >= 4 then 'loyal_customers'
         when recency_score = 4 and frequency_score = 1 then 'promising'
         when recency_score = 5 and frequency_score = 1 then 'new_customers'
         when frequency_score <= 3 then 'potential_loyalists'
         else 'champions' end as segment
  from scores)"""

CLTV = """
company as (
  select count(*)::double as n, 1 - (count(*) filter (orders > 1))::double / count(*) as churn_rate
  from totals),
cltv as (
  select customer_id, orders as total_transaction, units as total_unit, spend as total_price,
         spend / orders as avg_order_value, orders / n as purchase_frequency,
         spend * 0.38 as profit_margin,
         (spend / orders) * (orders / n) / nullif(churn_rate, 0) as customer_value,
         (spend / orders) * (orders / n) / nullif(churn_rate, 0) * (spend * 0.38) as cltv
  from totals cross join company)"""

CHURN = """
churned as (
  select s.*, c.* exclude (customer_id),
    (coalesce(recency_score = 1, false)
     or coalesce(recency_score = 2 and frequency_score <= 2 and monetary_score <= 2
                 and cltv <= 5112 and tenure <= 555.38, false)
     or coalesce(recency between 90 and 112 and frequency_score = 1 and monetary_score = 1
                 and cltv <= 204.67 and tenure <= 442, false))::bigint as churn
  from segments s join cltv c using (customer_id))"""

PURCHASES = """
purchases as (
  select user_id as customer_id, event_id as order_id, ts as order_ts,
         value::decimal(18,2) as value, 1.0::double as quantity
  from events where event_type = 'purchase')"""

CAMPAIGN = """
campaign as (
  select ts::date as day, case when user_id % 2 = 0 then 'control' else 'test' end as type,
         (count(*) filter (event_type = 'view'))::double as impression,
         (count(*) filter (event_type = 'click'))::double as click,
         (count(*) filter (event_type = 'purchase'))::double as purchase,
         coalesce(sum(value::decimal(18,2)) filter (event_type = 'purchase'), 0)::double as earning
  from events group by 1, 2)"""


def with_(*parts: str) -> str:
    return "with " + ",".join(p.strip() for p in parts) + "\n"


def sql_inverse_normal(u: str) -> str:
    """The normal quantile of an SQL expression between 0 and 1."""
    def rational(parts, x):
        def poly(c):
            out = f"{c[-1]!r}::double"
            for k in reversed(c[:-1]):
                out = f"({out} * {x} + {k!r}::double)"
            return out
        return f"({poly(parts[0])} / {poly(parts[1])})"
    t = f"sqrt(-ln(least({u}, 1 - {u})))"
    centre = rational(NORMAL_CENTRE, f"(0.180625 - ({u} - 0.5) * ({u} - 0.5))")
    return (f"(case when abs({u} - 0.5) <= 0.425 then ({u} - 0.5) * {centre} else sign({u} - 0.5) * "
            f"(case when {t} <= 5 then {rational(NORMAL_TAIL, f'({t} - 1.6)')} "
            f"else {rational(NORMAL_FAR, f'({t} - 5)')} end) end)")
