"""Targets, draws and words of the mixture."""

import random

import pytest

from clientele.llm.pareto_mix import allocate, mix, targets


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(out.values())
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
    return out


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 20, 80, 300]))),
             rng.choice(["a", "b", "b", "b", "b", "c", "É", None, "z"])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "empty"), (n + 2, " \n", None), (7, rows[7][1], rows[7][2]), (None, "x y", "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets(spark):
    sizes = {"a": 10, "b": 5000, "c": 0, "É": 700, None: 90, "z": 90}
    df = spark.createDataFrame([(s, n, 0, 0, 0) for s, n in sizes.items()],
                               "source string, total long, low long, high long, moment long")
    got = {r["source"]: r["target"] for r in targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_words_come_near_the_targets_and_reruns_agree(spark):
    rows, docs = corpus(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    seen = []
    for parts in (1, 7):
        out, c = allocate(docs.repartition(parts))
        got = out.collect()
        taken = {}
        for r in got:
            size = len((r["text"] or "").split())
            assert r[c["size"]] == size and r[c["source_size"]] == sizes[r["source"]]
            assert r[c["target"]] == pytest.approx(want[r["source"]])
            assert r[c["taken"]] == r[c["copies"]] * size <= 3 * size
            taken[r["source"]] = taken.get(r["source"], 0) + r[c["taken"]]
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)
        seen.append(sorted(((r["doc_id"], r["text"], r["source"], r[c["taken"]]) for r in got), key=repr))
    assert seen[0] == seen[1]


def test_longer_texts_are_likelier_and_certain_copies_come_first(spark):
    rows = [(i, "w " * (10 if i % 2 else 100), "a" if i < 3000 else "b") for i in range(4000)]
    out, c = allocate(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3))
    got = out.collect()
    part = lambda s, size: [r[c["copies"]] for r in got if r["source"] == s and r[c["size"]] == size]
    mean = lambda x: sum(x) / len(x)
    assert mean(part("a", 100)) > mean(part("a", 10)) > 0
    assert set(part("b", 100)) | set(part("b", 10)) <= {2, 3}


def test_mix_repeats_rows(spark):
    _, docs = corpus(spark, 60)
    docs = docs.withColumnRenamed("source", "source").selectExpr("*", "1 as size", "2 as mix_size", "3 as target")
    out, c = allocate(docs)
    assert c["size"] != "mix_size"
    want = {}
    for r in out.collect():
        want[r["doc_id"], r["text"]] = want.get((r["doc_id"], r["text"]), 0) + r[c["copies"]]
    got = {}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], docs.schema)
    out, c = allocate(blank)
    assert [(r[c["target"]], r[c["taken"]]) for r in out.collect()] == [(0.0, 0), (0.0, 0)]
