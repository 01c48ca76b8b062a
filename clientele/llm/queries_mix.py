"""Registered query of the source mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.pareto_mix import allocate
from clientele.llm.registry import register


@register("op1_source_mix")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, names = allocate(docs)
    return out.select("doc_id", *[F.col(names[c]).alias(c) for c in
                                  ("size", "source_size", "target", "copies", "taken")])
