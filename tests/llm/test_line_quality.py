"""Counts and verdicts of the quality rules on a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clientele.llm.line_quality import clean, judge

GOOD = "This is a plain sentence about nothing that ends as it should."


def repeats(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return len({p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)})


def verdicts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict() for r in judge(docs).orderBy("doc_id").collect()]


def test_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 40)]
    texts += [None, "a b c a b c", "x x x x", "#a *b\n#a *b\n\n \n \n%$&|<>", "é ö\x0bü\x0c\r\n", "one\n" * 2000]
    for t, r in zip(texts, verdicts(spark, texts)):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [line for line in t.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
        assert r["q_n_words"] == len(w) and r["q_word_chars"] == sum(map(len, w))
        assert r["q_n_symbols"] == len(re.findall("[#*$%&|<>]", t))
        assert r["q_n_dup_lines"] == len(lines) - len(set(lines))
        if len(w) < 100:
            assert r["q_n_repeat_words"] == repeats(t)
        assert r["q_base_failed"] == (len(w) < 50 or 100 * r["q_n_repeat_words"] > 50 * len(w))
        assert not (r["q_base_failed"] and r["q_kept"])


@pytest.mark.parametrize("line, fails", [
    (GOOD, False), ("Done?", False), ('"Quoted."', False), ("no end", True), ("Home | About | Contact.", True),
    ("ALL SHOUTED WORDS HERE!", True), ("Read more about it.", True), ("100%% $$ ## && ok.", True),
    ("", False), ("  ", False), ("Ende: »ja.«", False),
    ("A long line with an end. " + "word " * 30, False), ("word " * 30, True)])
def test_line_rules(spark, line, fails):
    r = verdicts(spark, [line])[0]
    assert (r["q_n_lines_removed"] == 1) == fails


def prose(n, seed=0):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) + "." for _ in range(n))


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.createDataFrame([
        (1, prose(8), "a", 1), (2, prose(8, 1) + "\nHome | News | Sport | Weather", "a", 2), (3, "A | B | C | D\n" * 30, "a", 3),
        (4, prose(2) + "\n" + "junk without end\n" * 30, None, 4), (5, None, "a", 5), (6, "Und " * 200, "a", 6),
        (1, prose(8), "a", 1)], "doc_id long, text string, source string, n_chars long")
    out = clean(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2] and out.count() == 3
    assert got[1]["text"] == prose(8) and got[1]["n_chars"] == 1
    assert got[2]["text"] == prose(8, 1) and got[2]["n_chars"] == len(prose(8, 1))
    assert clean(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, prose(8), 3)], "doc_id long, text string, q_n_words int")
    with pytest.raises(ValueError):
        judge(docs)
    assert clean(docs.withColumn("_quality_kept", F.lit(1))).columns == [*docs.columns, "_quality_kept"]


def test_plan_stays_in_column_arithmetic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("BatchEval|Arrow|Pandas|Exchange", plan)
