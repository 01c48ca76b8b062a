"""Registered query of the SimHash classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.registry import register
from clientele.llm.simhash import classes, fingerprints


@register("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(fingerprints(read_table(spark, sf_dir, "documents")))
    return found.select(F.col("doc").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
