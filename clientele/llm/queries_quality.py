"""Registered query of the line-first quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.line_quality import BOILERPLATE, judge
from clientele.llm.registry import register

SQL = r"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as p from w where len(w) > 2),
tri as (select doc_id, p, w[p:p + 2] as k from pos),
dup as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) as c from tri) where c > 1),
cover as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + 3)) as q from dup) group by 1),
lines as (select doc_id, unnest(string_split(t, chr(10))) as l, unnest(range(len(string_split(t, chr(10))))) as i from docs),
counted as (
  select doc_id, l, i, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
         len(regexp_extract_all(l, '[#*$%&|<>]')) as s,
         rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as r
  from lines),
judged as (
  select doc_id, l, i, n, s, n > 0 and (
    s * 10 >= n * 3
    or (not regexp_matches(right(r, 6), '[.!?…:;。！？؟۔।]["''”’“‘»«)\]]*$')
        and (n < 20 or not regexp_matches(l, '[.!?…。！？؟۔।]["''”’“‘»«)\]]*[\x20\x09-\x0D]')))
    or len(regexp_extract_all(' ' || replace(l, ' ', '  ') || ' ', '\s[|•·›»→>/]+\s')) * 4 >= n
    or (n > 2 and regexp_matches(l, '\p{Lu}') and not regexp_matches(l, '\p{Ll}'))
    or (n <= 30 and regexp_matches(l, '(?i)\b(?:BOILERPLATE)\b'))) as fails
  from counted),
per as (
  select doc_id, sum(s)::bigint as n_symbols, coalesce(sum(n) filter (fails), 0)::bigint as n_lost,
         (count(*) filter (n > 0) - count(distinct l) filter (n > 0))::bigint as n_dup_lines
  from judged group by doc_id)
select w.doc_id, len(w)::bigint as n_words, length(list_aggregate(list_concat(w, ['']), 'string_agg', ''))::bigint as word_chars,
       n_symbols, n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, n_lost,
       len(w) < 50 or 100 * coalesce(cover.n, 0) > 50 * len(w) as base_failed,
       not (len(w) < 50 or 100 * coalesce(cover.n, 0) > 50 * len(w)) and n_lost <= 0.5 * len(w) as kept
from w join per using (doc_id) left join cover using (doc_id)
""".replace("BOILERPLATE", "|".join(BOILERPLATE))


@register("op2_quality_rules", SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, prefix="")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "n_lost", "base_failed", "kept")
