"""Projections, scalar functions, filters, joins, sorts and set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clientele.functions import scalars as S
from clientele.operators import customers, joins
from clientele.operators.order_stats import bin_of, label_of, quantile_edges
from clientele.plans.oracle import LINES, METRICS, SCORES, SEGMENTS, TOTALS, with_
from clientele.plans.registry import query
from clientele.sources.tables import campaign, order_lines, orders_as_lines, purchases, table
from clientele.plans.oracle import CAMPAIGN, PURCHASES


# --- projections and scalar functions ---------------------------------------------------------

@query("select_drop_rename", """
select o_custkey as customer_id, o_orderkey as order_id, o_orderdate as order_ts,
       o_orderstatus as order_status from orders""")
def select_drop_rename(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return o.drop("o_totalprice").withColumnsRenamed({
        "o_custkey": "customer_id", "o_orderkey": "order_id",
        "o_orderdate": "order_ts", "o_orderstatus": "order_status"})


@query("line_total", """
select l_orderkey as order_id, l_linenumber::bigint as line_number,
       round(l_quantity * (l_extendedprice / l_quantity), 6) as total_price from lineitem""")
def line_total(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_number"),
        F.round(S.line_total("l_quantity", F.col("l_extendedprice") / F.col("l_quantity")), 6)
        .alias("total_price"))


@query("safe_ratio", with_(CAMPAIGN) + """
select day::varchar as day, type, round(earning / nullif(purchase, 0), 6) as earning_per_purchase,
       round(click / nullif(impression, 0), 6) as click_rate from campaign""")
def safe_ratio(spark, sf):
    return campaign(spark, sf).select(
        F.col("day").cast("string").alias("day"), "type", F.round(S.safe_ratio("earning", "purchase"), 6).alias("earning_per_purchase"),
        F.round(S.safe_ratio("click", "impression"), 6).alias("click_rate"))


@query("const_cast_concat", """
select c_custkey as customer_id, 'control' as type, floor(c_acctbal)::bigint as balance,
       concat(c_nationkey, c_mktsegment) as code from customer""")
def const_cast_concat(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.lit("control").alias("type"),
        F.floor("c_acctbal").cast("long").alias("balance"),
        S.score_text("c_nationkey", "c_mktsegment").alias("code"))


@query("parse_ts", """
select event_id, ts as parsed, ts as parsed_iso, null::timestamp as unreadable,
       timestamp '2011-12-11 00:00:00' as fixed_day from events""")
def parse_ts(spark, sf):
    # The text of a time at a whole second has no point to put the digits behind.
    text = F.col("ts").cast("string")
    pointed = F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
    return table(spark, sf, "events").select(
        "event_id",
        S.parse_ts(F.rpad(pointed, F.lit(26), F.lit("0")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
        S.parse_ts(text).alias("parsed_iso"),
        S.parse_ts("event_type").alias("unreadable"),
        S.as_of_literal(datetime(2011, 12, 11)).alias("fixed_day"))


@query("date_shift_span", """
select user_id as customer_id, max(ts) + interval 1 day as as_of, max(ts) - interval 90 day as earlier,
       floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::bigint as span_days from events group by user_id""")
def date_shift_span(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("customer_id")).agg(
        S.shift_days(F.max("ts"), 1).alias("as_of"), S.shift_days(F.max("ts"), -90).alias("earlier"),
        S.day_diff(F.max("ts"), F.min("ts")).alias("span_days"))


@query("day_diff", """
select event_id,
  floor((epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(ts)) / 86400000000)::bigint as days
from events""")
def day_diff(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", S.day_diff(S.as_of_literal(datetime(2024, 1, 15, 12)), "ts").alias("days"))


@query("regex_map", with_(LINES, TOTALS, METRICS, SCORES, SEGMENTS) + """
select customer_id, rfm_score, segment from segments""")
def regex_map(spark, sf):
    scored = customers.rfm_scores(customers.rfm_metrics(order_lines(spark, sf)))
    return scored.select("customer_id", "rfm_score", S.map_patterns(
        "rfm_score", customers.segment_patterns()).alias("segment"))


@query("case_assign", """
select l_orderkey as order_id, l_linenumber::bigint as line_number,
       case when l_quantity > 40 then 40 when l_quantity < 5 then 5 else l_quantity end as quantity,
       coalesce(case when l_returnflag = 'R' then 1 end, 0)::bigint as returned from lineitem""")
def case_assign(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_number"),
        F.when(q > 40, 40.0).when(q < 5, 5.0).otherwise(q).alias("quantity"),
        F.coalesce(F.when(F.col("l_returnflag") == "R", 1), F.lit(0)).cast("long").alias("returned"))


@query("threshold_flag", """
select o_orderkey as order_id, (o_totalprice / 500000 > 0.5)::bigint as flag from orders""")
def threshold_flag(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        S.threshold_flag(F.col("o_totalprice") / 500000).alias("flag"))


@query("abs_round", """
select c_custkey as customer_id, abs(c_acctbal) as size, round(c_acctbal, 0) as whole
from customer""")
def abs_round(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.abs("c_acctbal").alias("size"),
        F.round("c_acctbal", 0).alias("whole"))


# --- filters ----------------------------------------------------------------------------------

@query("filter_positive", """
select c_custkey as customer_id, c_acctbal as balance from customer
where c_acctbal > 0 and c_mktsegment = 'BUILDING'""")
def filter_positive(spark, sf):
    return (table(spark, sf, "customer").where((F.col("c_acctbal") > 0)
                                               & (F.col("c_mktsegment") == "BUILDING"))
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance")))


@query("drop_cancelled", with_(LINES) + """
select invoice, line_number, quantity from lines where not contains(invoice, 'C')""")
def drop_cancelled(spark, sf):
    return (order_lines(spark, sf).where(S.null_safe_not(F.col("invoice").contains("C")))
            .select("invoice", "line_number", "quantity"))


@query("filter_expr", """
select l_orderkey as order_id, l_quantity as quantity, l_discount as discount from lineitem
where (l_quantity < 10 or l_discount >= 0.05) and not (l_returnflag = 'A')""")
def filter_expr(spark, sf):
    return (table(spark, sf, "lineitem")
            .where("(l_quantity < 10 or l_discount >= 0.05) and not (l_returnflag = 'A')")
            .select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"),
                    F.col("l_discount").alias("discount")))


@query("last_90_days", """
select o_orderkey as order_id, o_orderdate as order_ts from orders
where o_orderdate > (select max(o_orderdate) - interval 90 day from orders)""")
def last_90_days(spark, sf):
    o = table(spark, sf, "orders")
    # One value on the driver: as a literal the bound reaches the Parquet scan.
    last = o.agg(S.shift_days(F.max("o_orderdate"), -90)).first()[0]
    return (o.where(F.col("o_orderdate") > S.as_of_literal(last))
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_ts")))


@query("dropna_any", """
select event_id, event_type, nullif(event_type, 'error') as kind, value from events
where event_type <> 'error' and value is not null""")
def dropna_any(spark, sf):
    return (table(spark, sf, "events")
            .select("event_id", "event_type",
                    F.nullif(F.col("event_type"), F.lit("error")).alias("kind"), "value")
            .na.drop("any"))


# --- joins ------------------------------------------------------------------------------------

@query("features_to_lines", with_(LINES, TOTALS, METRICS) + """
select l.customer_id, order_id, line_number, value::double as value, recency, frequency,
       round(monetary, 2) as monetary
from lines l left join metrics m using (customer_id)""")
def features_to_lines(spark, sf):
    lines = order_lines(spark, sf)
    joined = joins.attach(lines.select("customer_id", "order_id", "line_number", "value"),
                          customers.rfm_metrics(lines, count_lines=True), "customer_id", rows="n_lines")
    return joined.withColumns({"value": F.col("value").cast("double"),
                               "monetary": F.round("monetary", 2)})


@query("feature_join", with_(LINES, TOTALS, METRICS) + """
select customer_id, recency, tenure, frequency from metrics""")
def feature_join(spark, sf):
    lines = order_lines(spark, sf)
    return (customers.rfm_metrics(lines).select("customer_id", "recency", "frequency")
            .join(customers.tenure(lines), "customer_id", "left"))


CITY_SEGMENT = with_(LINES, """
cities as (select city, sum(value)::double as sales from lines group by city),
e as (select quantile_cont(sales, [.2,.4,.6,.8]) as edges from cities),
city_segments as (
  select city, sales, ['E','D','C','B','A'][1 + len(list_filter(edges, lambda z: sales > z))] as city_segment
  from cities cross join e)""")


@query("city_join", CITY_SEGMENT + """
select l.city, order_id, line_number, city_segment
from lines l left join city_segments using (city)""")
def city_join(spark, sf):
    from clientele.operators.features import with_city_segment
    return with_city_segment(order_lines(spark, sf, city=True)).select(
        "city", "order_id", "line_number", "city_segment")


@query("row_key_join", """
select o_orderkey as order_id, (o_orderstatus = 'F')::bigint as label, o_totalprice / 500000 as prob
from orders""")
def row_key_join(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "order_id")
    label = o.select("order_id", (F.col("o_orderstatus") == "F").cast("long").alias("label"))
    prob = o.select("order_id", (F.col("o_totalprice") / 500000).alias("prob"))
    return label.join(prob, "order_id")


@query("anti_join", """
select c_custkey as customer_id, c_name as name from customer
where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)""")
def anti_join(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(
        F.col("o_custkey").alias("customer_id"))
    return joins.drop_matching(c, big, "customer_id")


@query("semi_update", """
select o_orderkey as order_id, o_custkey as customer_id,
  case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 1
       else (o_orderstatus = 'P')::bigint end as flag from orders""")
def semi_update(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        (F.col("o_orderstatus") == "P").cast("long").alias("flag"))
    debtors = table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("customer_id"))
    return joins.update_matching(o, debtors, "customer_id", "flag", F.lit(1).cast("long"))


@query("scalar_broadcast", """
select o_orderkey as order_id, round(o_totalprice / (select max(o_totalprice) from orders), 6) as share,
       (select count(*) from orders) as n_orders from orders""")
def scalar_broadcast(spark, sf):
    o = table(spark, sf, "orders")
    whole = o.agg(F.max("o_totalprice").alias("largest"), F.count("*").alias("n_orders"))
    return joins.with_scalars(o, whole).select(
        F.col("o_orderkey").alias("order_id"),
        F.round(F.col("o_totalprice") / F.col("largest"), 6).alias("share"), "n_orders")


# --- sort, limit, sets ------------------------------------------------------------------------

@query("full_sort", """
select c_custkey as customer_id, c_acctbal as balance from customer order by c_acctbal desc, c_custkey""")
def full_sort(spark, sf):
    return (table(spark, sf, "customer")
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
            .orderBy(F.desc("balance"), "customer_id"))


@query("head_tail", """
(select 'head' as part, o_orderkey as order_id from orders order by o_orderkey limit 5)
union all
(select 'tail' as part, o_orderkey as order_id from orders order by o_orderkey desc limit 5)""")
def head_tail(spark, sf):
    from clientele.operators.profiling import head_tail as ends
    return ends(table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), "order_id")


@query("slice_rows", """
select o_orderkey as order_id, o_totalprice as total from orders
order by o_totalprice desc, o_orderkey limit 10 offset 180""")
def slice_rows(spark, sf):
    from clientele.operators.profiling import slice_rows as rows
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))
    return rows(o, [F.desc("total"), F.asc("order_id")], 180, 190)


@query("union_common", with_(PURCHASES) + """
select customer_id, order_id, order_ts, value::double as value from (
  select o_custkey as customer_id, o_orderkey as order_id, o_orderdate as order_ts,
         o_totalprice::decimal(18,2) as value from orders
  union all select customer_id, order_id, order_ts, value from purchases)""")
def union_common(spark, sf):
    from clientele.operators.profiling import union_common as concat_rows
    a = orders_as_lines(spark, sf).withColumn("source", F.lit("orders")).drop("quantity")
    return concat_rows([a, purchases(spark, sf)]).withColumn("value", F.col("value").cast("double"))


@query("distinct_values", """
select distinct o_orderstatus as order_status, o_orderpriority as order_priority from orders""")
def distinct_values(spark, sf):
    return (table(spark, sf, "orders")
            .select(F.col("o_orderstatus").alias("order_status"),
                    F.col("o_orderpriority").alias("order_priority"))
            .dropDuplicates())


# --- ranking ----------------------------------------------------------------------------------

@query("rank_first", with_(LINES, TOTALS, METRICS) + """
select customer_id, frequency, row_number() over (order by frequency, customer_id) as frequency_rank
from metrics""")
def rank_first(spark, sf):
    from clientele.operators.order_stats import rank_first as ordinal_rank
    metrics = customers.rfm_metrics(order_lines(spark, sf)).select("customer_id", "frequency")
    return ordinal_rank(metrics, "frequency", "customer_id", "frequency_rank")


@query("qcut_labels", """
with e as (select quantile_cont(o_totalprice, [.25,.5,.75]) as edges from orders)
select o_orderkey as order_id, ['D','C','B','A'][1 + len(list_filter(edges, lambda z: o_totalprice > z))] as class
from orders cross join e""")
def qcut_labels(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    edges = quantile_edges(o, {"total": ("o_totalprice", 4)})["total"]
    return o.select("order_id", label_of(bin_of("o_totalprice", edges),
                                         ["D", "C", "B", "A"]).alias("class"))


@query("qcut_rank", with_(LINES, TOTALS, METRICS, SCORES) + """
select customer_id, frequency_score from scores""")
def qcut_rank(spark, sf):
    from clientele.operators.order_stats import rank_bin, rank_cuts
    metrics = customers.rfm_metrics(order_lines(spark, sf)).select("customer_id", "frequency")
    cuts = rank_cuts(metrics, "frequency", "customer_id", 5)
    return metrics.select("customer_id", rank_bin("frequency", "customer_id", cuts)
                          .alias("frequency_score"))
