"""SimHash fingerprints of word shingles and the classes of documents they link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clientele.llm.common import fresh, sized, stage
from clientele.llm.components import components
from clientele.llm.vantage import RADIUS, near_links

SHINGLE = 4
_CHUNK = 1 << 16  # shingles whose bits are laid out at a time


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words give zero."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in
                           zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE) -> DataFrame:
    """(doc, row, fp) of every row; ``row`` is xxhash64 of the text, a null one counting as empty."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = {text: fingerprint(text, width) for text in set(texts)}
            made = np.array([known[t] for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())],
                                             ["doc", "row", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("t"))
    return rows.mapInArrow(run, "doc long, row long, fp long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc, row, fp) with ``component_id``, the smallest id that links reach.

    Equal fingerprints are one point, so a group of copies costs one row. Null ids never name a
    class unless it has no other.
    """
    prints = stage(prints, "prints")
    points = stage(prints.groupBy("fp").agg(F.min("doc").alias("low")), "points")
    roots = stage(components(near_links(points, "fp", radius), "a", "b"), "roots")
    named = (points.join(roots, points["fp"] == roots["node"]).groupBy("root").agg(F.min("low").alias("class_low")))
    linked = roots.join(named, "root").select("node", "class_low")
    of = (points.join(linked, points["fp"] == linked["node"], "left")
          .select("fp", F.coalesce("class_low", "low").alias("component_id")))
    return prints.join(of, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each class: the one with the smallest id, of those the smallest hash of the text.

    Columns are as in ``docs``. Rows that repeat id and text count once; null ids come last.
    """
    return keep_lowest(docs, classes(fingerprints(docs, id_col, text_col), radius), id_col, text_col)


def keep_lowest(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each class of ``found`` (doc, row, fp, component_id), as ``keep_one`` says.

    Only ids and hashes decide: the texts meet the list of rows that go, and are not dealt out unless
    that list is too long to send.
    """
    # Rows without any id are told apart by the fingerprint, so each class still has a name.
    lead = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("row").alias("row"))
    rows = stage(found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("name"), "doc", "row")
                 .agg(F.count("*").alias("n")), "class rows")
    first = rows.groupBy("component_id", "name").agg(F.min(lead).alias("lead")).select(
        F.col("lead.none").alias("none"), F.col("lead.doc").alias("doc"), F.col("lead.row").alias("row"))
    keys = [F.col("doc").isNull().alias("k_none"), F.coalesce("doc", F.lit(0).cast("long")).alias("k_doc"),
            F.col("row").alias("k_row")]
    leads = first.select(*keys)
    named = rows.select(*keys, "n").groupBy("k_none", "k_doc", "k_row").agg(F.sum("n").alias("n"))
    same = ["k_none", "k_doc", "k_row"]
    go = stage(named.join(leads.withColumn("leads", F.lit(True)), same, "left")
               .where(F.col("leads").isNull() | (F.col("n") > 1)).select(*same, F.col("leads").isNotNull().alias("twice")), "go")
    none, doc, row = (fresh(k, docs.columns) for k in ("_none", "_doc", "_row"))
    keyed = docs.withColumns({none: F.col(id_col).cast("long").isNull(),
                              doc: F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")),
                              row: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    on = (F.col(none) == F.col("k_none")) & (F.col(doc) == F.col("k_doc")) & (F.col(row) == F.col("k_row"))
    once = keyed.join(sized(go), on, "left_anti")
    # Leads that are repeated rows: one of each stays.
    twice = keyed.join(sized(stage(go.where("twice"), "twice")), on, "left_semi").dropDuplicates([none, doc, row])
    return once.unionByName(twice).drop(none, doc, row)
