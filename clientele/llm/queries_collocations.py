"""Registered query of the phrase mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.llm.collocations import collocations
from clientele.llm.common import read_table
from clientele.llm.registry import register

SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from docs),
ws as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
size as (select lang, sum(len(w))::hugeint as n from ws group by lang),
grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
  from (select lang, w, m, unnest(range(1, (len(w) - m + 2)::bigint)) as i
        from ws, (values (1), (2), (3), (4)) v(m) where len(w) >= m)),
counts as (select lang, m, phrase, count(*)::hugeint as a from grams group by all having count(*) >= 30),
long as (select *, string_split(phrase, ' ') as w from counts where m > 1),
cuts as (
  select g.lang, g.phrase, g.m, g.a, k, l.a as l, r.a as r, (2000000 * g.a) // (l.a + r.a) as score
  from (select *, unnest(range(1, m)) as k from long) g
  join counts l on l.lang = g.lang and l.phrase = array_to_string(g.w[1:k], ' ')
  join counts r on r.lang = g.lang and r.phrase = array_to_string(g.w[k + 1:g.m], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_spans as (
  select lang, a, array_to_string(w[i:i + s - 1], ' ') as phrase
  from (select *, unnest(range(1, m - s + 2)) as i from (select *, unnest(range(2, m)) as s from long))),
outers as (select lang, phrase, max(a) as outer_a from inner_spans group by all),
left_over as (
  select c.* from lowest c left join outers o using (lang, phrase)
  where coalesce(100 * outer_a < 80 * a, true)),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
       score::bigint as score
from ranked join size using (lang) where rank <= 2000
"""


@register("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))
