"""Jaccard classes against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from clientele.llm import jaccard
from clientele.llm.line_quality import clean


def slow_set(text, n=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def slow_classes(texts):
    """The smallest index that links reach, of each text."""
    sets, low = [slow_set(t) for t in texts], list(range(len(texts)))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a == sets[j] or common and 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                x, y = top(i), top(j)
                low[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def some_texts(rng, n=240):
    """Texts and edited copies of them, chains included, some just below and some just above the limit."""
    out = [" ".join(str(rng.randrange(5000)) for _ in range(rng.choice([1, 3, 6, 40, 120, 400]))) for _ in range(n // 4)]
    while len(out) < n:
        words = rng.choice(out[-60:]).split()
        for _ in range(rng.choice([0, 1, max(1, len(words) // 45), max(1, len(words) // 40), len(words) // 20])):
            words[rng.randrange(len(words))] = str(rng.randrange(5000))
        out.append(" ".join(words))
    return out + ["", "  ", None]


def test_walk():
    texts = some_texts(random.Random(3))
    sets = [jaccard.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(slow_set(t)) for t in texts]
    want = slow_classes(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    got = jaccard.walk([sets[i] for i in full])
    assert [full[k] for k in got] == [want[i] for i in full]
    assert len(set(want)) < len(texts) - 40


@pytest.mark.parametrize("most", [jaccard.TASK_SHINGLES, 300])
def test_classes(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", most)
    texts = some_texts(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == slow_classes(texts)


def test_copies_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (4, None), (8, ""), (7, " "), (None, "alone here"),
            (None, "alone here"), (2, "other text of this table")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, point string")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == [2, 3, 4, None]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_stage_links_at_jaccard_of_four_fifths(spark):
    """The pipeline's stage on the rows it gets, pairs more than four SimHash bits apart included."""
    sf = "/root/testdata/sf0.01"
    before = clean(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("doc_id")
    rows = before.collect()
    after = corpus_pipeline.near_dedup(spark, before, sf)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(
        {rows[k]["doc_id"] for k in slow_classes([r["text"] for r in rows])})
    texts = " ".join(map(str, range(200))), " ".join("x" if i in (30, 90, 150) else str(i) for i in range(200))
    pair = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = map(slow_set, texts)
    assert len(a & b) / len(a | b) > 0.8
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, pair, sf).collect()] == [0]


def test_bands_are_spread():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2))
    other = np.concatenate([own[:250], own[250:] + np.uint64(1)])
    shared = sum(a == b for a, b in zip(jaccard.band_keys(own), jaccard.band_keys(np.unique(other))))
    assert shared < jaccard.BANDS // 5
