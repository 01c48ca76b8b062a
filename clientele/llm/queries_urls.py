"""Registered query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.llm.common import read_table
from clientele.llm.registry import register
from clientele.llm.url_filter import judge_urls


@register("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, judged = judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *[F.col(judged)[c].alias(c) for c in ("host", "path", "rule", "verdict")])
