"""Registered query of the source audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.llm.common import read_table
from clientele.llm.divergence_cube import divergences
from clientele.llm.registry import register

SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
words as (select d, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as c from words group by all having count(distinct d) >= 3),
counts as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
langs as (select lang, sum(c)::bigint as n, count(*) as v from kept group by lang),
groups as (
  select g.lang, g.source, coalesce(t.n, 0) as n, coalesce(l.v, 0) as v, coalesce(l.n, 0) as lang_n
  from (select distinct lang, source from docs) g left join langs l using (lang)
  left join (select lang, source, sum(c)::bigint as n from counts group by all) t
    on t.lang = g.lang and t.source = g.source),
grid as (
  select g.lang, g.source, k.term, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + g.v) as p
  from groups g join kept k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pair p on p.lang = a.lang and p.source = a.source and p.item = b.source),
term as (
  select c.lang, c.source, c.term as item, 1 + (1000000000 * (c.c + 1)) // (g.n + g.v) as p,
         1 + (1000000000 * (k.c + 1)) // (g.lang_n + g.v) as q
  from counts c join kept k on k.lang = c.lang and k.term = c.term
  join groups g on g.lang = c.lang and g.source = c.source),
terms as (
  select lang, source, 'term' as part, item, (((p - q) * (p - q)) // q)::bigint as value from term where p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


@register("op12_source_divergence", SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))
