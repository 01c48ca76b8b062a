"""Line dedup against a brute-force version, and the runs by themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clientele.llm.line_runs import LineRuns, dedup_lines

SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_chars=20, min_docs=3):
    keyed = [(d, [(line, lower(line.strip(SPACES))) for line in (t or "").split("\n")]) for d, t in rows]
    docs, last = {}, {}
    for d, lines in keyed:
        for k in {k for _, k in lines if len(k) >= min_chars}:
            docs[k] = docs.get(k, 0) + 1
            last[k] = max(x for x in (last.get(k), d) if x is not None) if (k in last and last[k] is not None) or \
                d is not None else None
    out = []
    for d, lines in keyed:
        keep = [line for line, k in lines
                if not (len(k) >= min_chars and docs[k] >= min_docs and d != last[k])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def collect(df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()], key=repr)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    pool = [f"  Shared line number {i} of the corpus ÄÖ {'x' * i}\t" for i in range(8)] + ["short", "", "é" * 20, "é" * 19]
    rows = [(i, "\n".join(rng.choice(pool + [f"only in document {i} and nowhere else"]) for _ in range(rng.randint(1, 9))))
            for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "A very LONG shared line, twice\na very long shared LINE, twice"),
             (64, "a very long shared line, twice"), (65, "a very long shared line, twice "), (66, "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collect(dedup_lines(docs)) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    line = "this line is in all of these documents"
    rows = [(1, line), (1, line), (2, line + "\nx"), (None, line)]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows],
                                 "doc_id long, text string, n_lines int, kept_text string")
    out = dedup_lines(docs)
    assert out.columns[:4] == ["doc_id", "text", "n_lines", "kept_text"] and len(out.columns) == 7
    dropped = out.columns[5]
    got = sorted(((r["doc_id"], r[dropped]) for r in out.collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 0), (None, 1)], key=repr)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_compacted_by_level(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        keys = spark.range(b, b + 4).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"),
                                            F.lit(1).cast("long").alias("n_docs"), F.col("id").alias("max_doc"))
        fresh, known = runs.add(keys)
        assert (fresh, known) == ((4, 0) if b == 0 else (1, 3))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five batches: one of four, one of one
    got = {r["h1"]: r["n_docs"] for r in runs.totals().collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 3, 6: 2, 7: 1}
    unseen = runs.unseen(spark.createDataFrame([(3, 0), (99, 0)], "h1 long, h2 long"))
    assert [r["h1"] for r in unseen.collect()] == [99]


def test_bad_fanout(spark):
    with pytest.raises(ValueError):
        LineRuns(spark, fanout=1)


def test_digest_is_of_the_kept_text(spark):
    from clientele.llm.catalog import runs
    row = runs()["op10_line_dedup"](spark, "/root/testdata/sf0.001").where("n_dropped = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
