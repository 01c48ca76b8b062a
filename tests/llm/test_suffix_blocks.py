"""Blocks of the benchmark: bounded, without copies, held one at a time."""

import random
import tracemalloc

from clientele.llm import suffix_match
from clientele.llm.suffix_match import Block, add_matches


def test_memory_of_a_block():
    rng = random.Random(2)
    items = [(str(i), " ".join(f"w{rng.randrange(100_000):05}" for _ in range(100))) for i in range(1500)]
    tracemalloc.start()
    Block(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_copies_are_sent_once(spark):
    bench = spark.createDataFrame([(1, "one two three")] * 500 + [(2, "four"), (None, "four")], "item_id int, text string")
    sent = list(suffix_match._blocks(bench, "item_id", "text", 1 << 20))
    assert [sorted(rows) for rows in sent] == [[("", "four"), ("1", "one two three"), ("2", "four")]]
    assert len(list(suffix_match._blocks(bench.where("item_id = 1"), "item_id", "text", 100))) == 1


def test_one_block_in_a_plan(spark):
    bench = spark.createDataFrame([(i, f"item number {i} of them") for i in range(20)], "item_id int, text string")
    docs = spark.createDataFrame([(0, "item number 3 of them"), (1, "nothing")], "doc_id int, text string")
    out, _, found = add_matches(docs, bench, block_bytes=300)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r["doc_id"]: [m["item_id"] for m in r[found]] for r in out.collect()} == {0: ["3"], 1: []}
