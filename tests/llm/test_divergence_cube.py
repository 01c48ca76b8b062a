"""The source audit against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from clientele.llm import divergence_cube as c


def slow(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= min_docs)
        v, own = len(kept), sorted(s for g, s in groups if g == lang)
        p = {}
        for s in own:
            total = sum(counts[lang, s, t] for t in kept)
            p[s] = [1 + 10**9 * (counts[lang, s, t] + 1) // (total + v) for t in kept]
        whole = [sum(counts[lang, s, t] for s in own) for t in kept]
        q = [1 + 10**9 * (n + 1) // (sum(whole) + v) for n in whole]
        for s in own:
            pair = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode()) for o in own if o != s)
            term = sorted((-((a - b) ** 2 // b), t.encode()) for t, a, b in zip(kept, p[s], q) if a > b and counts[lang, s, t])
            for part, found in (("pair", pair), ("term", term[:top])):
                out += [(lang, s, part, i.decode(), -x, k) for k, (x, i) in enumerate(found, 1)]
    return sorted(out)


def some_rows(rng):
    words = ["Alpha", "beta", "gamma", "\u00e9t\u00e9", "x1y", "don't", "\u4e2d\u6587", "Q" * 30]
    rows = [(" ".join(rng.choice(words[:rng.randint(1, 8)]) + str(rng.choice(["", "", "!", "_k"])) for _ in range(rng.randrange(25))),
             rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None])) for _ in range(120)]
    return rows + [(None, "en", "only null"), ("", "fr", "a"), ("once", "fr", "b"), (None, "xx", "alone"), *rows[:4]]


@pytest.mark.parametrize("group_block, term_block", [(32, 1 << 15), (2, 3), (1, 1)])
def test_against_brute_force(spark, monkeypatch, group_block, term_block):
    monkeypatch.setattr(c, "SHARD_TERMS", 90)
    monkeypatch.setattr(c, "_CHUNK_BYTES", 60)
    rows = some_rows(random.Random(group_block))
    df = spark.createDataFrame([(*r, 3) for r in rows], "text string, lang string, source string, term long").repartition(4)
    got = c.divergences(df, group_block=group_block, term_block=term_block, top_terms=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow(rows, top=5)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert c.divergences(df).count() == 0


def test_weights_are_exact():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.choice([rng.randrange(1, 50), rng.randrange(1, 10**15)])
        n = rng.randrange(total)
        assert c.weights(np.array([n]), total)[0] == 1 + 10**9 * (n + 1) // total
