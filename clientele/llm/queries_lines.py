"""Registered query of the line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.line_runs import dedup_lines
from clientele.llm.registry import register

SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (
  select k, max(doc_id) as last_doc from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
marked as (
  select l.doc_id, l.line, l.pos, c.k is not null and l.doc_id <> c.last_doc as gone
  from keyed l left join common c on l.k = c.k)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@register("op10_line_dedup", SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
