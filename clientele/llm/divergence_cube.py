"""How the sources of each language differ in their terms: chi-square-like divergences in exact integers.

The pairs of sources are worked out in a cube. A cell is (block of groups, block of groups, block of
terms); it gets the count slices of its two group blocks for its term block, which are sent to every
cell that needs them, and sums the divergences of its pairs over its terms. The partial sums of a
pair are then added up along the term axis. So neither all terms of a group nor all groups of a
language ever meet in one task.

A group is a (language, source) that occurs; null language, source and text count as ''. Documents
are rows: repeated ones and ones with null ids all count. A language without a kept term has
divergences of 0 and no term rows; no rows give no result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.llm.common import stage

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
GROUP_BLOCK = 32
TERM_BLOCK = 1 << 15
SHARD_TERMS = 2_500_000
_CHUNK_BYTES = 4 << 20

_STOP = b"\xff"  # in no UTF-8 text
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Terms of one language, as numbers, until they are counted; number 0 begins a document."""

    def __init__(self):
        self.known = _Numbers({_STOP: 0})
        self.sources: list[str] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, sources: list[str], texts: list[bytes]) -> None:
        found = b"".join(b" \xff " + t.translate(_FOLD) for t in texts).split()
        self.parts.append(np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)))
        self.sources += sources
        self.size += len(found)

    def counts(self, lang: str) -> pa.RecordBatch:
        """lang, source, term, n, n_docs."""
        ids = np.concatenate(self.parts)
        doc = np.cumsum(ids == 0) - 1
        names, group = np.unique(np.array(self.sources, object), return_inverse=True)
        words, base = list(self.known), len(self.known)
        real = ids > 0
        key, times = np.unique(group[doc[real]] * base + ids[real], return_counts=True)
        once = np.unique(doc[real] * base + ids[real])
        pairs, docs = np.unique(group[once // base] * base + once % base, return_counts=True)
        assert len(pairs) == len(key)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(key), np.int64))),
             pa.array(names.tolist(), pa.string()).take(pa.array(key // base)),
             pa.array(words, pa.binary()).take(pa.array(key % base)), pa.array(times), pa.array(docs)],
            ["lang", "source", "term", "n", "n_docs"])


def _counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, n_docs) of each task's documents."""
    def run(batches):
        shards: dict[str, _Shard] = {}
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                mine = pc.equal(langs, lang)
                sources, held, size = [], [], 0
                shard = shards.setdefault(lang, _Shard())
                for source, text in zip(batch.column(1).filter(mine), batch.column(2).filter(mine)):
                    sources.append(source.as_py())
                    held.append(text.as_py())
                    size += len(held[-1])
                    if size >= _CHUNK_BYTES:
                        shard.add(sources, held)
                        sources, held, size = [], [], 0
                if held:
                    shard.add(sources, held)
            while shards and sum(s.size for s in shards.values()) >= SHARD_TERMS:
                lang = max(shards, key=lambda k: shards[k].size)
                yield shards.pop(lang).counts(lang)
        for lang, shard in shards.items():
            yield shard.counts(lang)

    rows = docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source"),
                       _named(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")


def _named(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, leads) of the terms in enough documents; one row of a term leads."""
    dealt = _counted(docs, text_col, lang_col, source_col).repartition("lang", "term")
    by_group = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    same = Window.partitionBy("lang", "term")
    return (by_group.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("n_docs").over(same),
                                  "leads": F.min("source").over(same) == F.col("source")})
            .where(F.col("lang_docs") >= min_docs)
            .select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "leads"))


def _weight(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in longs, digit by digit; total stays below 9e15 words."""
    digits, left = F.lit(0).cast("long"), n + 1  # n + 1 <= total
    for _ in range(3):
        left = left * 1000
        digits = digits * 1000 + _div(left, total)
        left = left % total
    return digits + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def weights(n: np.ndarray, total: int) -> np.ndarray:
    """The same on an array."""
    digits, left = np.zeros(n.shape, np.int64), n + 1
    for _ in range(3):
        left = left * 1000
        digits = digits * 1000 + left // total
        left = left % total
    return digits + 1


def _cell(key: tuple, slices: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, item, value): the sums of the cell's pairs over its terms."""
    lang, i, j, _ = key
    names = groups["source"].tolist()
    block = groups["block"].to_numpy()
    v, n_terms = (int(groups[c].iloc[0]) for c in ("v", "n_terms")) if len(groups) else (0, 0)
    place = {s: k for k, s in enumerate(names)}
    term, terms = pd.factorize(slices["term"])
    counts = np.zeros((len(names), len(terms)), np.int64)
    counts[slices["source"].map(place).to_numpy(np.int64), term] = slices["n"].to_numpy(np.int64)
    absent = n_terms - len(terms)  # kept terms of the block that none of these groups has
    p = none = None
    if v:
        totals = [int(n) + v for n in groups["group_n"]]
        p = np.stack([weights(c, t) for c, t in zip(counts, totals)])
        none = [int(weights(np.zeros(1, np.int64), t)[0]) for t in totals]
    out = []
    for a in np.flatnonzero(block == i).tolist():
        for b in np.flatnonzero(block == j).tolist():
            if a == b or i == j and a > b:
                continue
            for x, y in ((a, b), (b, a)):
                value = 0
                if v:
                    gap = p[x] - p[y]
                    value = int((gap * gap // p[y]).sum()) + absent * ((none[x] - none[y]) ** 2 // none[y])
                out.append((lang, names[x], names[y], value))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
                term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank), ranked within each group and part from 1.

    Part ``pair`` compares a source with every other one of its language, ``term`` lists the terms
    that the source has more often than its language, the first ``top_terms`` of them. Ties go by item.
    """
    kept = stage(kept_terms(docs, text_col, lang_col, source_col, min_docs), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"),
                                                F.sum(F.col("leads").cast("long")).alias("led"))
    same = Window.partitionBy("lang")  # a row per source of the language
    zero = F.lit(0).cast("long")
    groups = (docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source")).distinct()
              .join(totals, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("group_n", zero).alias("group_n"), F.coalesce("led", zero).alias("led"))
              .withColumns({"v": F.sum("led").over(same), "total_n": F.sum("group_n").over(same),
                            "blocks": F.ceil(F.count("*").over(same) / F.lit(group_block)).cast("int")})
              .withColumns({"block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"),
                            "term_blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(term_block))).cast("int")})
              .drop("led"))
    groups = stage(groups, "groups")
    rows = kept.join(groups, ["lang", "source"])

    p, q = _weight(F.col("n"), F.col("group_n") + F.col("v")), _weight(F.col("lang_n"), F.col("total_n") + F.col("v"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = (rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
             .select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms))

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    term_at = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")
    cell = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    slices = (rows.select("lang", "source", "term", "n", "block", term_at.alias("t"), other.alias("other"))
              .select("lang", *cell, "t", "source", "term", "n"))
    sizes = (rows.where("leads").groupBy("lang", term_at.alias("t")).agg(F.count("*").alias("n_terms")))
    owners = (groups.withColumn("other", other)
              .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
              .join(sizes, ["lang", "t"], "left")
              .select("lang", *cell, "t", "source", "group_n", "v", "block", F.coalesce("n_terms", zero).alias("n_terms")))
    keys = ["lang", "i", "j", "t"]
    partial = slices.groupBy(*keys).cogroup(owners.groupBy(*keys)).applyInPandas(
        _cell, "lang string, source string, item string, value long")
    pairs = (partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    both = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
            for part, d in (("pair", pairs), ("term", terms))]
    return both[0].union(both[1])
