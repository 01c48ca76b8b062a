"""Verbatim matches against a brute-force search."""

import random
import re

from pyspark.sql import functions as F

from clientele.llm.suffix_match import Block, add_matches, covered_words, decontaminate, match_texts, spans_of


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(n, len(v))
        if not k:
            continue
        windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p:p + k]) in windows:
                hit.update(range(p, p + k))
                found.add(item)
    return len(w), len(hit), found


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, m: " ".join(rng.choice("abcdefgh"[:m]) for _ in range(n))
    items = [(str(i), say(rng.choice([1, 3, 9, 10, 14, 30]), rng.choice([2, 8]))) for i in range(12)]
    items += [("n", None), ("e", ""), ("0", items[0][1]), ("p", "!!! ...")]
    texts = [say(rng.randint(0, 60), rng.choice([2, 3, 8])) for _ in range(60)]
    texts += [items[5][1] + " z " + items[7][1].upper(), None, "", "É, é " * 30, "b" * 5000]
    return items, texts


def test_matches_are_those_of_brute_force():
    for seed in range(6):
        items, texts = corpus(seed)
        counts, matches = match_texts(Block([(i, t) for i, t in items if t is not None]), texts)
        for t, n, m in zip(texts, counts, matches):
            hit = sum(b - a for a, b in spans_of(m))
            assert (n, hit, {x[0] for x in m}) == brute(t, items), (seed, t)
            for item, start, at, length in m:
                own = [words(x) for i, x in items if i == item]
                assert any(words(t)[start:start + length] == v[at:at + length] for v in own)


def test_a_match_is_the_longest():
    item = " ".join(f"w{i}" for i in range(40))
    text = "x " + " ".join(f"w{i}" for i in range(5, 31)) + " y"
    _, matches = match_texts(Block([("a", item)]), [text])
    assert matches == [[("a", 1, 5, 26)]]


def test_blocks_of_the_benchmark_give_the_same(spark):
    items, texts = corpus(11)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, bench_words long")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = []
    for size in (1 << 20, 300):
        out, n, found = add_matches(docs.repartition(3), bench, block_bytes=size)
        assert n != "bench_words" and out.columns[:3] == docs.columns
        got.append(sorted((r["doc_id"], r[n], r["hit"], tuple(sorted({m["item_id"] for m in r[found]})))
                          for r in out.withColumn("hit", covered_words(F.col(found))).collect()))
    assert got[0] == got[1]
    assert got[0] == [(i, *(brute(t, items)[:2]), tuple(sorted(brute(t, items)[2]))) for i, t in enumerate(texts)]


def test_decontaminate_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "clean"), (None, None), (2, "clean")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, "TWO, three. Four")], "item_id long, text string")
    out = decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == [2, 2, None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 1
    assert decontaminate(docs.limit(0), none).count() == 0
