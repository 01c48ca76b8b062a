"""Licence passages against a brute-force search."""

import random
import time

import pytest

from clientele.llm.catalog import runs
from clientele.llm.licences import TEMPLATES, Scanner, add_licences, bigrams
from clientele.llm.suffix_match import fold_words


def brute_dice(text, template):
    """The best coefficient over all passages of the text."""
    w, own = fold_words(text), set(bigrams(fold_words(template)))
    best = 0.0
    for i in range(len(w)):
        for j in range(i + 2, len(w) + 1):
            seen = set(bigrams(w[i:j]))
            best = max(best, 2 * len(seen & own) / (len(seen) + len(own)))
    return best


def test_best_passage_is_that_of_brute_force():
    rng = random.Random(1)
    templates = (("a", "one two three four five six"), ("b", "one two three"), ("c", "six five four one two"))
    for _ in range(150):
        text = " ".join(rng.choice("one two three four five six x y".split()) for _ in range(rng.randint(0, 16)))
        for t in templates:
            found = Scanner((t,)).scan(text)
            best = max((d for _, d, _, _ in found), default=0.0)
            want = brute_dice(text, t[1])
            assert best == pytest.approx(want if want >= 0.8 else 0.0), (text, t)


def slow_windows(scanner, grams):
    """The best passage from each place, every end looked at."""
    mine, out = scanner.sets[0], []
    for i, g in enumerate(grams):
        best = None
        for j in range(i, len(grams)):
            seen = set(grams[i:j + 1])
            dice = 2 * len(seen & mine) / (len(seen) + len(mine))
            if g in mine and dice >= scanner.threshold and (best is None or dice > best[0]):
                best = dice, i, j + 1
        if best:
            out.append(best)
    return out


def test_passages_of_every_start_are_those_of_brute_force():
    rng = random.Random(2)
    scanner = Scanner((("a", "one two three four five six one three"),))
    for _ in range(200):
        words = fold_words(" ".join(rng.choice("one two three four five six x".split()) for _ in range(rng.randint(0, 40))))
        assert list(scanner._windows(bigrams(words), 0)) == slow_windows(scanner, bigrams(words))


def test_very_long_repeats():
    began = time.monotonic()
    found = Scanner().scan("all rights reserved " * 50_000)
    assert {n for n, *_ in found} == {"all-rights-reserved"} and time.monotonic() - began < 20


def test_query_gives_the_passages_of_its_operator(spark):
    sf = "/root/testdata/sf0.001"
    got = runs()["op9_licence_scan"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    scanner = Scanner()
    want = []
    for r in docs:
        found = scanner.scan(r["text"])
        want.append((r["doc_id"], len(found), ",".join(sorted({m[0] for m in found})),
                     max((m[1] for m in found), default=None), sum(m[3] for m in found)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(w[1] for w in want)


def test_templates_find_themselves():
    scanner = Scanner()
    for name, text in TEMPLATES:
        padded = "Before it, some words. " + text.replace("\n", " \n ").upper() + "\nAnd after it."
        assert name in {n for n, d, _, _ in scanner.scan(padded) if d > 0.95}


def test_near_misses():
    scanner = Scanner()
    assert scanner.scan("Licensed under CC BY-NC 4.0 ")[0][0] == "CC-BY-NC-4.0"
    assert scanner.scan("This work is licensed under the GNU General Public License, version 2")[0][0] == "GPL-2.0"
    assert scanner.scan("All of the rights are reserved for the driver") == []
    assert [scanner.scan(t) for t in (None, "", "all", "all rights")] == [[], [], [], []]


def test_table(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny " + "z " * 50_000, "k"), (2, None, None), (1, "All rights reserved.", "k"),
            (None, "All rights reserved.", "k")]
    out, name = add_licences(spark.createDataFrame(rows, "doc_id long, text string, licences string"))
    assert name != "licences" and out.columns == ["doc_id", "text", "licences", name]
    got = sorted(((r["doc_id"], [m["licence"] for m in r[name]]) for r in out.collect()), key=repr)
    assert got == sorted([(1, ["MIT"]), (2, []), (1, ["all-rights-reserved"]), (None, ["all-rights-reserved"])], key=repr)
    assert add_licences(out.select("doc_id", "text").limit(0))[0].count() == 0


def test_parameters():
    with pytest.raises(ValueError):
        Scanner(threshold=0)
    with pytest.raises(ValueError):
        Scanner((("x", "word"),))
