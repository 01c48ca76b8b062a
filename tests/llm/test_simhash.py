"""Fingerprints, links and classes against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clientele.llm import vantage
from clientele.llm.components import components
from clientele.llm.simhash import classes, fingerprint, fingerprints, keep_one


def slow_print(text, n=4):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius=4):
    """The smallest index that links reach, of each print."""
    low = list(range(len(prints)))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                low[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def some_prints(rng, n=900):
    seeds = [rng.getrandbits(64) for _ in range(n // 6)] + [0, (1 << 64) - 1]
    out = list(seeds)
    while len(out) < n:
        out.append(flipped(rng, rng.choice(out[-50:] if rng.random() < 0.3 else seeds), rng.choice([0, 1, 3, 4, 5, 8])))
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b C d E", "é É ß x \x0b y", "to " * 500,
                                  " ".join(map(str, range(70_000)))])
def test_fingerprint(text):
    assert fingerprint(text) == slow_print(text)


def test_links_in_a_shard():
    rng = random.Random(5)
    prints = np.unique(np.array(some_prints(rng, 3000), np.uint64))
    want = slow_classes(prints.tolist())
    label = np.arange(len(prints))
    pairs = []
    for part, mask in enumerate(vantage.part_masks()):
        rest = tuple(m for k, m in enumerate(vantage.part_masks()) if k != part)
        pairs.append(vantage.links(prints, mask, 1, 4, rest))
    label = vantage._settle(len(prints), np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    assert label.tolist() == want


def test_points_that_a_part_cannot_cut():
    rng = random.Random(6)
    mask = vantage.part_masks()[0]
    prints = np.unique(np.array([rng.getrandbits(64) & ~int(mask) & (2**64 - 1) for _ in range(900)]
                                + [flipped(rng, 0, 2) & ~int(mask) for _ in range(300)], np.uint64))
    rest = tuple(vantage.part_masks()[1:])
    for others in (rest, ()):
        a, b = vantage.links(prints, mask, 1, 4, others)
        assert vantage._settle(len(prints), a, b).tolist() == slow_classes(prints.tolist())


@pytest.mark.parametrize("most", [vantage.MAX_SHARD_ROWS, 40])
def test_links_over_shards(spark, monkeypatch, most):
    monkeypatch.setattr(vantage, "MAX_SHARD_ROWS", most)
    prints = some_prints(random.Random(7))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(i, 0, p) for i, p in enumerate(signed)], "doc long, row long, fp long").repartition(4)
    monkeypatch.setattr(vantage, "SHARD_ROWS", 64)
    got = {r["doc"]: r["component_id"] for r in classes(rows).collect()}
    assert [got[i] for i in range(len(prints))] == slow_classes(prints)


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(path + star + [(5, 5), (None, 3), (-7, 2000)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)} | {-7: -7, 2000: -7}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (4, None), (8, ""), (7, " "), (None, "alone here"),
            (None, "alone here"), (2, "other text of this table")]
    docs = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, source string, fp int")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == [2, 3, 4, None]
    assert keep_one(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    from clientele.llm.catalog import runs
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [slow_print(r["text"]) for r in docs]
    low = slow_classes(prints)
    want = {r["doc_id"]: (f"{p:016x}", docs[k]["doc_id"]) for r, p, k in zip(docs, prints, low)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in runs()["op6_simhash_near_dedup"](spark, sf).collect()}
    assert got == want
    assert fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).where(F.col("fp").isNull()).count() == 0
