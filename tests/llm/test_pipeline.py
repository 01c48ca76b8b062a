"""The pipeline's stages, each against a brute-force version on its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clientele.llm.common import stage
from clientele.llm.line_quality import judge
from clientele.llm.pareto_mix import allocate
from clientele.llm.queries_tokens import tokenizer_path
from test_jaccard import slow_classes
from test_suffix_match import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, docs, SF), name)
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination",
                                                      "source_mix", "token_output"]
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality(steps):
    before, after = steps["quality_rules"]
    want = [r["doc_id"] for r in judge(before).where("q_kept").collect()]
    assert ids(after) == sorted(want) and 0 < len(want) < before.count()
    whole = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        lines = whole[r["doc_id"]].split("\n")
        kept = iter(lines)
        assert all(line in kept for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])


def test_near_dedup(steps):
    before, after = steps["near_dedup"]
    rows = before.orderBy("doc_id").collect()
    low = slow_classes([r["text"] for r in rows])
    assert ids(after) == sorted({rows[k]["doc_id"] for k in low})


def test_decontamination(spark, steps):
    before, after = steps["benchmark_decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if not brute(r["text"], items)[1])


def test_mixture(steps):
    before, after = steps["source_mix"]
    planned, names = allocate(before)
    want = [r["doc_id"] for r in planned.collect() for _ in range(r[names["copies"]])]
    assert ids(after) == sorted(want)


def test_tokens(steps):
    before, after = steps["token_output"]
    direct = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for r in before.orderBy("doc_id").collect():
        own = [*direct.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in after.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_gives_the_last_stage(spark, steps):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, steps["token_output"][1].collect()))


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string"
    empty = spark.createDataFrame([], schema)
    good = "\n".join(" ".join(f"word{i * 12 + k}" for k in range(12)) + "." for i in range(8))
    odd = spark.createDataFrame([(1, good, None, None, None, 1, "x"), (1, good, None, None, None, 1, "x"), (2, None, "en", "a", 0, 2, None),
                                 (None, good + "\nmore of it.", "en", "a", 3, 3, "y"), (3, "", "", "", 0, None, "")], schema)
    for docs in (empty, odd):
        for name, apply in corpus_pipeline.STAGES:
            after = stage(apply(spark, docs, SF), name)
            assert name == "token_output" or after.columns == docs.columns
            docs = after
    assert docs.count() >= 1
