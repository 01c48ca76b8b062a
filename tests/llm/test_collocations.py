"""Phrase mining against brute force, and the automata by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from clientele.llm import collocations as c
from clientele.llm.count_automata import CountAutomaton, compose, from_rows, union


def slow(rows, least, percent, top):
    """rows: (text, lang)."""
    upper = {k: k + 32 for k in range(65, 91)}
    grams, size = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            size[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    grams.setdefault(lang, Counter())[tuple(w[i:i + n])] += 1
    out = []
    for lang, counted in grams.items():
        found = {g: a for g, a in counted.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            cover = any(len(o) > len(g) and 100 * b >= percent * a and
                        any(o[i:i + len(g)] == g for i in range(len(o) - len(g) + 1)) for o, b in found.items())
            if not cover:
                score, k = min((2_000_000 * a // (counted[g[:k]] + counted[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), counted[g[:k]], counted[g[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, l, r, size[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def some_rows(rng, n=150):
    words = ["New", "york", "the", "of", "\u00e9t\u00e9", "a\x00b", "x\x1fy", "z" * 40, "\u4e2d"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"])
                       for _ in range(rng.randrange(30)))
        out.append((text, rng.choice(["en", "en", "de", None, ""])))
    return out + [(None, "en"), ("", None), (" . ", "fr"), (None, None)]


@pytest.mark.parametrize("least, percent, top", [(5, 80, 2000), (2, 50, 7), (3, 100, 2000)])
def test_against_brute_force(spark, monkeypatch, least, percent, top):
    monkeypatch.setattr(c, "SHARD_WORDS", 200)
    monkeypatch.setattr(c, "_CHUNK_BYTES", 100)
    monkeypatch.setattr(c, "_UNION_ROWS", 10)
    rows = some_rows(random.Random(least))
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n long").repartition(5)
    got = c.collocations(df, min_count=least, percent=percent, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = slow(rows, least, percent, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert c.collocations(df).count() == 0
    assert c.collocations(spark.createDataFrame([(None, None), ("a b c", "x")], df.schema)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = some_rows(random.Random(9))
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(c, "FILTER_BITS", 17)
    monkeypatch.setattr(c, "_BLOCK", 16)
    tight = sorted(map(tuple, c.collocations(df, min_count=4).collect()))
    assert tight == slow(rows, 4, 80, 2000)


def rows_of(automaton: CountAutomaton) -> dict:
    columns, weight = automaton.rows()
    return {tuple(automaton.symbols[i] for i in at): w for *at, w in zip(*[x.tolist() for x in columns], weight.tolist())}


def build(rows: dict, depth: int) -> CountAutomaton:
    words = sorted({w for r in rows for w in r}, reverse=True) + [b"unused"]
    at = {w: i for i, w in enumerate(words)}
    columns = [np.array([at[r[d]] for r in rows], np.int64) for d in range(depth)]
    return from_rows(words, columns, np.array(list(rows.values()), np.int64))


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_automata(depth):
    rng = random.Random(depth)
    for _ in range(60):
        parts = [{tuple(rng.choice([b"a", b"b", b"", b"cc", b"\xc3\xa9"]) for _ in range(depth)): rng.randrange(1, 9) * rng.choice([1, 1 << 40])
                  for _ in range(rng.randrange(0, 40))} for _ in range(3)]
        made = [CountAutomaton.unpack(build(p, depth).pack()) for p in parts]
        assert [rows_of(m) for m in made] == parts
        want = Counter()
        for p in parts:
            want.update(p)
        assert rows_of(union(made)) == dict(want)
        assert rows_of(union(made, 6)) == {k: v for k, v in want.items() if v >= 6}
        both = {k: parts[1][k] for k in parts[0] if k in parts[1]}
        assert rows_of(compose(made[0], made[1])) == both


def test_equal_states_are_one():
    rows = {(a, b, x): 5 for a in (b"p", b"q", b"r") for b in (b"s", b"t") for x in (b"u", b"v")}
    made = build(rows, 3)
    assert [len(x) for x in made.label] == [3, 2, 2] and rows_of(made) == rows
