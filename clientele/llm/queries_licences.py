"""Registered query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.licences import add_licences
from clientele.llm.registry import register


@register("op9_licence_scan")
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = add_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["licence"])))
    return docs.select(
        "doc_id", F.size(found).cast("long").alias("n_passages"), F.array_join(names, ",").alias("licences"),
        F.array_max(F.transform(found, lambda m: m["dice"])).alias("best_dice"),
        F.aggregate(found, F.lit(0).cast("long"), lambda s, m: s + m["n_words"]).alias("n_licence_words"))
