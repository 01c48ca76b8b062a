"""Registered query of the HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.registry import register
from clientele.llm.wrappers import extract


@register("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, text = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars"))
