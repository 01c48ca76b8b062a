"""Registered query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.registry import register
from clientele.llm.suffix_match import add_matches, covered_words

SQL = r"""
with dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
      lambda w: w <> '') as w from documents),
iw as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
      lambda w: w <> '') as w from benchmark),
widths as (select distinct least(10, len(w)) as n from iw where len(w) > 0),
ip as (select item_id, least(10, len(w)) as n, w, unnest(range(1, (len(w) - least(10, len(w)) + 2)::bigint)) as i
       from iw where len(w) > 0),
iwin as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from ip),
dp as (select doc_id, n, w, unnest(range(1, (len(w) - n + 2)::bigint)) as p from dw, widths where len(w) >= n),
dwin as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as k from dp),
hits as (select d.doc_id, d.n, d.p, i.item_id from dwin d join iwin i on d.n = i.n and d.k = i.k),
cover as (select doc_id, count(distinct q) as n_hit
          from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
          from (select distinct doc_id, item_id::varchar as s from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from dw left join cover using (doc_id) left join names using (doc_id)
"""


@register("op8_benchmark_decontamination", SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, words, found = add_matches(docs, read_table(spark, sf_dir, "benchmark"))
    marked = marked.drop("text")
    ids = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["item_id"])))
    n_hit = covered_words(F.col(found))
    return marked.select(
        "doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
