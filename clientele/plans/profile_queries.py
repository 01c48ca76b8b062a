"""Profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import cleaning, profiling
from clientele.plans.oracle import LINES, with_
from clientele.plans.registry import query
from clientele.sources.tables import order_lines, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _per_column(columns, make):
    return "\nunion all ".join(make(c) for c in columns)


@query("check_df", _per_column(
    [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0),
     ("o_totalprice", "double", 1), ("o_orderdate", "timestamp_ntz", 0),
     ("o_orderpriority", "string", 0)],
    lambda c: f"""select '{c[0]}' as "column", '{c[1]}' as dtype, count(*) as n,
  count(*) - count({c[0]}) as n_miss, """ + ("""round(avg({0}), 4) as mean,
  round(stddev_samp({0}::double), 4) as std, min({0})::double as min, max({0})::double as max,
  round(quantile_cont({0}::double, .05), 4) as q5, round(quantile_cont({0}::double, .5), 4) as q50,
  round(quantile_cont({0}::double, .95), 4) as q95, round(quantile_cont({0}::double, .99), 4) as q99"""
    .format(c[0]) if c[2] else """null::double as mean, null::double as std, null::double as min,
  null::double as max, null::double as q5, null::double as q50, null::double as q95,
  null::double as q99""") + " from orders"))
def check_df(spark, sf):
    return _rounded(profiling.check_df(table(spark, sf, "orders")),
                    ["mean", "std", "q5", "q50", "q95", "q99"], 4)


@query("describe", _per_column(
    LINE_NUMBERS,
    lambda c: f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, min({c}) as min, round(quantile_cont({c}, .05), 4) as q5,
  round(quantile_cont({c}, .3), 4) as q30, round(quantile_cont({c}, .5), 4) as q50,
  round(quantile_cont({c}, .8), 4) as q80, round(quantile_cont({c}, .9), 4) as q90,
  round(quantile_cont({c}, .95), 4) as q95, round(quantile_cont({c}, .99), 4) as q99,
  max({c}) as max from lineitem"""))
def describe(spark, sf):
    d = profiling.describe(table(spark, sf, "lineitem"), LINE_NUMBERS,
                           [.05, .30, .50, .80, .90, .95, .99])
    return _rounded(d, ["mean", "std", "q5", "q30", "q50", "q80", "q90", "q95", "q99"], 4)


@query("missing_values", """
with t as (select event_id, nullif(event_type, 'error') as kind, nullif(user_id % 5, 0) as remainder,
                  value from events)
select * from (
  select 'kind' as "column", count(*) - count(kind) as n_miss,
         round(100.0 * (count(*) - count(kind)) / count(*), 2) as ratio from t
  union all select 'remainder', count(*) - count(remainder),
         round(100.0 * (count(*) - count(remainder)) / count(*), 2) from t
  union all select 'value', count(*) - count(value),
         round(100.0 * (count(*) - count(value)) / count(*), 2) from t) where n_miss > 0""")
def missing_values(spark, sf):
    return profiling.missing_values(table(spark, sf, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"),
        F.nullif(F.col("user_id") % 5, F.lit(0).cast("long")).alias("remainder"), "value"))


def _role_sql(columns):
    counts = _per_column(columns, lambda c: (
        f"""select '{c[0]}' as "column", {c[1]} as is_text, count(distinct {c[0]}) as n from """
        """(select * from lineitem join orders on l_orderkey = o_orderkey)"""))
    return f"""select "column", case when is_text and n > 20 then 'cardinal' when is_text then 'categorical'
  when n < 10 then 'categorical' else 'numeric' end as role from ({counts})"""


@query("column_roles", _role_sql([
    ("l_quantity", "false"), ("l_extendedprice", "false"), ("l_tax", "false"),
    ("l_linenumber", "false"), ("l_returnflag", "true"), ("o_orderstatus", "true"),
    ("o_orderpriority", "true"), ("o_custkey", "false")]))
def column_roles(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_returnflag", "o_orderstatus",
        "o_orderpriority", "o_custkey")
    roles = profiling.column_roles(joined)
    return spark.createDataFrame([(c, role) for role, cs in roles.items() for c in cs],
                                 "column string, role string")


@query("rare_levels", _per_column(
    ["o_orderstatus", "o_orderpriority"],
    lambda c: f"""select '{c}' as "column", {c} as level, count(*) as n,
  round(avg((o_totalprice > 250000)::int), 6) as target_mean,
  round(count(*) / (select count(*) from orders), 6) as ratio from orders group by {c}"""))
def rare_levels(spark, sf):
    o = table(spark, sf, "orders").withColumn("target", (F.col("o_totalprice") > 250000).cast("int"))
    return _rounded(profiling.rare_levels(o, "target", ["o_orderstatus", "o_orderpriority"]),
                    ["target_mean", "ratio"])


def _corr_sql(columns):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return _per_column(pairs, lambda p: f"select '{p[0]}' as a, '{p[1]}' as b, corr({p[0]}, {p[1]}) as r from lineitem")


@query("corr_ranked", f"""
select distinct round(r, 6) as r from ({_corr_sql(LINE_NUMBERS)} union all select '', '', 1.0)""")
def corr_ranked(spark, sf):
    pairs = profiling.correlations(table(spark, sf, "lineitem"), LINE_NUMBERS, diagonal=True)
    return profiling.ranked_correlations(pairs)


@query("corr_strong", f"""
select a, b, round(r, 6) as r from ({_corr_sql(LINE_NUMBERS)}) where r >= 0.0 and r <> 1""")
def corr_strong(spark, sf):
    """The masked matrix: pairs at or above a limit, without perfect ones."""
    pairs = profiling.correlations(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return profiling.strong_pairs(pairs, 0.0).select("a", "b", F.round("r", 6).alias("r"))


# Many columns with gaps: remainders of the line's keys, missing where another remainder is 0.
WIDE = [(f"c{k}", f"case when (l_partkey + l_linenumber) % {k % 5 + 3} = 0 then null "
                  f"else (l_orderkey * {k} + l_suppkey) % {2 * k + 3} end") for k in range(1, 41)]


@query("corr_wide", "with w as (select " + ", ".join(f"{e} as {c}" for c, e in WIDE) + " from lineitem)\n" + _per_column(
    [(a[0], b[0]) for i, a in enumerate(WIDE) for b in WIDE[i + 1:]],
    lambda p: f"select '{p[0]}' as a, '{p[1]}' as b, round(corr({p[0]}, {p[1]}), 6) as r from w"))
def corr_wide(spark, sf):
    """All pairs of many columns, each over the rows that have both."""
    wide = table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE])
    return profiling.correlations(wide).select("a", "b", F.round("r", 6).alias("r"))


@query("high_corr", f"""
select distinct b as "column" from ({_corr_sql(LINE_NUMBERS)}) where abs(r) > 0.5""")
def high_corr(spark, sf):
    pairs = profiling.correlations(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return profiling.highly_correlated(pairs, 0.5)


@query("histogram", """
with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
b as (select least(floor((o_totalprice - lo) / ((hi - lo) / 20))::bigint + 1, 20) as bin, count(*) as n
      from orders cross join m group by 1)
select i as bin, round(lo + (i - 1) * ((hi - lo) / 20), 4) as low, round(lo + i * ((hi - lo) / 20), 4) as high,
       coalesce(n, 0)::bigint as n
from range(1, 21) t(i) left join b on b.bin = i cross join m""")
def histogram(spark, sf):
    return _rounded(profiling.histogram(table(spark, sf, "orders"), "o_totalprice", 20),
                    ["low", "high"], 4)


@query("box_numbers", _per_column(
    ["l_quantity", "l_extendedprice"],
    lambda c: f"""select '{c}' as "column", round(min({c}) filter ({c} between lo and hi), 4) as whisker_low,
  round(any_value(q1), 4) as q25, round(any_value(q2), 4) as q50, round(any_value(q3), 4) as q75,
  round(max({c}) filter ({c} between lo and hi), 4) as whisker_high,
  count(*) filter ({c} < lo or {c} > hi) as n_outside
from lineitem cross join (select q1, q2, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont({c}, .25) as q1, quantile_cont({c}, .5) as q2, quantile_cont({c}, .75) as q3
  from lineitem))"""))
def box_numbers(spark, sf):
    return _rounded(profiling.box_numbers(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]),
                    ["whisker_low", "q25", "q50", "q75", "whisker_high"], 4)


# --- cleaning ---------------------------------------------------------------------------------

def _limits_sql(table_name, columns, low, high):
    return _per_column(columns, lambda c: f"""select '{c}' as "column", a - 1.5 * (b - a) as low_limit,
  b + 1.5 * (b - a) as up_limit
from (select quantile_cont({c}, {low}) as a, quantile_cont({c}, {high}) as b from {table_name})""")


@query("outlier_limits", f"""
select "column", round(low_limit, 4) as low_limit, round(up_limit, 4) as up_limit
from ({_limits_sql("lineitem", LINE_NUMBERS, .05, .95)})""")
def outlier_limits(spark, sf):
    li = table(spark, sf, "lineitem")
    return _rounded(cleaning.limits_frame(li, cleaning.outlier_limits(li, LINE_NUMBERS)),
                    ["low_limit", "up_limit"], 4)


@query("winsorise", """
with m as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from (
  select quantile_cont(o_totalprice, .25) as a, quantile_cont(o_totalprice, .30) as b from orders))
select o_orderkey as order_id, round(case when o_totalprice < lo then lo when o_totalprice > hi then hi
       else o_totalprice end, 4) as total from orders cross join m""")
def winsorise(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))
    # Narrow quantiles, so that the limits do cut on evenly distributed data.
    limits = cleaning.outlier_limits(o, ["total"], 0.25, 0.30)
    return _rounded(cleaning.winsorise(o, limits), ["total"], 4)


@query("has_outlier", """
with lim as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from (
  select quantile_cont(value, .05) as a, quantile_cont(value, .95) as b from events)),
lim2 as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from (
  select quantile_cont(user_id::double, .05) as a, quantile_cont(user_id::double, .95) as b from events))
select 'value' as "column", bool_or(value < lo or value > hi) as has_outlier from events cross join lim
union all
select 'user_id', bool_or(user_id < lo or user_id > hi) from events cross join lim2""")
def has_outlier(spark, sf):
    e = table(spark, sf, "events")
    return cleaning.has_outlier(e, cleaning.outlier_limits(e, ["value", "user_id"]))


REMOVE = with_(f"""
lim as (select min(low_limit) filter ("column" = 'l_quantity') as ql, max(up_limit) filter ("column" = 'l_quantity') as qu,
               min(low_limit) filter ("column" = 'l_extendedprice') as pl,
               max(up_limit) filter ("column" = 'l_extendedprice') as pu
        from ({_limits_sql("lineitem", ["l_quantity", "l_extendedprice"], .40, .50)}))""")


@query("remove_outliers", REMOVE + """
select l_orderkey as order_id, l_linenumber::bigint as line_number, l_quantity as quantity,
       l_extendedprice as price
from lineitem cross join lim
where not (l_quantity < ql or l_quantity > qu) and not (l_extendedprice < pl or l_extendedprice > pu)""")
def remove_outliers(spark, sf):
    li = table(spark, sf, "lineitem")
    limits = cleaning.outlier_limits(li, ["l_quantity", "l_extendedprice"], 0.40, 0.50)
    return cleaning.remove_outliers(li, limits).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


@query("row_loss", REMOVE + """
select count(*) as "rows", count(*) filter (l_extendedprice < pl or l_extendedprice > pu) as removed,
       round(100.0 * count(*) filter (l_extendedprice < pl or l_extendedprice > pu) / count(*), 6) as removed_percent
from lineitem cross join lim""")
def row_loss(spark, sf):
    li = table(spark, sf, "lineitem")
    limits = cleaning.outlier_limits(li, ["l_quantity", "l_extendedprice"], 0.40, 0.50)
    return _rounded(cleaning.row_loss(li, limits, mode="last"), ["removed_percent"])


@query("retail_clean", with_(LINES) + """
select invoice, product_id, line_number, quantity, round(unit_price, 8) as unit_price,
       round(quantity * unit_price, 8) as total_price
from lines where not contains(invoice, 'C') and quantity > 0 and unit_price > 0""")
def retail_clean(spark, sf):
    lines = order_lines(spark, sf).select(
        "invoice", "product_id", "line_number", "quantity", "unit_price")
    return _rounded(cleaning.retail_clean(lines), ["unit_price", "total_price"], 8)
