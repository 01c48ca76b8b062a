"""Registered query of the token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.llm.common import read_table
from clientele.llm.registry import register
from clientele.llm.token_store import encode_to_store

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where the vocabulary file is on this machine; workers have it at the same place."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@register("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_store(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
