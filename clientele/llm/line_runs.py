"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n_docs, max_doc), one row per line hash, sorted by hash. A
batch of lines is merge-joined with all runs: hashes that no run holds are its fresh ones, the
others only add to a count. Both become a run on level 0. When a level holds ``fanout`` runs they
are merged into one sorted run of the next level, so a hash is rewritten once per level and there
are few runs to join with. Runs are written tables in the shared folder: a lost executor costs
nothing but the tasks it ran.

Lines are told apart by 128 bits of XXH3 over their key.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clientele.llm.common import ASCII_SPACES, fresh, shared_folder, stage

MIN_KEY_CHARS = 20
MIN_DOCS = 3
HASH = ["h1", "h2"]
_RUN = "h1 long, h2 long, n_docs long, max_doc long"


class LineRuns:
    """The levels of runs, each a list of folders."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_folder(self.spark, f"line-run-l{level}")
        rows.repartition("h1").sortWithinPartitions(*HASH).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def entries(self) -> DataFrame:
        """All rows of all runs; a hash has a row in each run that mentions it."""
        paths = [p for level in self.levels for p in level]
        reader = self.spark.read.schema(_RUN)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _RUN)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose hash no run holds."""
        return rows.join(self.entries().select(*HASH), HASH, "left_anti")

    def add(self, keys: DataFrame) -> tuple[int, int]:
        """Take in a batch, one row per hash: (h1, h2, n_docs, max_doc). Gives (fresh, known).

        The anti join marks what is fresh; one run then takes both, since a known hash is a row
        whose count the next compaction adds to the older one.
        """
        keys = stage(keys.select("h1", "h2", "n_docs", "max_doc"), "line-batch")
        total = keys.count()
        if not total:
            return 0, 0
        new = self.unseen(keys).count() if any(self.levels) else total
        self._write(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = _merge(self.spark.read.schema(_RUN).parquet(*self.levels[level]))
            self._write(merged, level + 1)
            self.levels[level] = []
            level += 1
        return new, total - new

    def totals(self) -> DataFrame:
        """One row per hash over all runs."""
        return _merge(self.entries())


def _merge(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def hash_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc, row, pos, h1, h2, is_first) of every line whose key has ``min_chars`` code points.

    The key is the line without ASCII white space at its ends and with A-Z lower-cased. ``row``
    tells rows with equal ids and different texts apart; ``is_first`` marks the first line of a
    text with that key.
    """
    strip, schema = ASCII_SPACES.encode(), "doc long, row long, pos int, h1 long, h2 long, is_first boolean"

    def run(batches):
        for batch in batches:
            doc, row, pos, h1, h2, first = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                raw = text.encode()
                mark = xxhash.xxh64_intdigest(raw, 42)  # what xxhash64() gives in SQL
                mark -= (mark >> 63) << 64
                seen = set()
                for i, line in enumerate(raw.split(b"\n")):
                    key = line.strip(strip)
                    if len(key) < min_chars:
                        continue
                    key = key.lower()  # of bytes: A-Z only
                    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    a, b = struct.unpack(">qq", digest)
                    doc.append(d)
                    row.append(mark)
                    pos.append(i)
                    h1.append(a)
                    h2.append(b)
                    first.append(digest not in seen)
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()),
                 pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first, pa.bool_())],
                ["doc", "row", "pos", "h1", "h2", "is_first"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS, batches: int = 4,
                fanout: int = 3) -> DataFrame:
    """``docs`` with the new columns ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of at least ``min_chars`` code points that ``min_docs`` rows hold loses its lines in all
    rows but those with the largest id. The rows come in ``batches`` by id range, each through the
    runs; every row counts, repeated rows as documents of their own. A null or empty text is one
    empty line; rows with null ids never hold the kept copy unless no id is known. Names that
    clash with columns of ``docs`` get a suffix.
    """
    spark = docs.sparkSession
    lines = stage(hash_lines(docs, id_col, text_col, min_chars), "lines")
    runs = LineRuns(spark, fanout)
    low, high = lines.agg(F.min("doc"), F.max("doc")).first()
    low, high = (0, 0) if low is None else (low, high)
    # In decimals: ids may lie far apart.
    part = F.expr(f"coalesce((cast(doc as decimal(20, 0)) - {low}) div {(high - low) // batches + 1}, 0)")
    for i in range(batches):
        batch = lines.where("is_first").where(part == i)
        runs.add(batch.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc")))
    common = stage(runs.totals().where(F.col("n_docs") >= min_docs).select(*HASH, "max_doc"), "common")
    gone = (lines.join(common, HASH).where(~F.col("doc").eqNullSafe(F.col("max_doc")))
            .groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    n_lines, n_dropped, kept = (fresh(c, docs.columns) for c in ("n_lines", "n_dropped", "kept_text"))
    mark, key, at = (fresh(c, docs.columns) for c in ("_row", "_doc", "_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({key: F.col(id_col).cast("long"), mark: F.xxhash64(text)})
    gone = gone.select(F.col("doc").alias("g_doc"), F.col("row").alias("g_row"), F.col("gone").alias("g_at"))
    out = marked.join(gone, marked[mark].eqNullSafe(gone["g_row"]) & marked[key].eqNullSafe(gone["g_doc"]),
                      "left")
    out = out.withColumnRenamed("g_at", at)
    split, size = F.split(text, "\n"), F.size(F.col(at))
    # What lies between two dropped positions is kept: a slice for each gap.
    start = lambda k: F.when(k == 0, 0).otherwise(F.element_at(F.col(at), k) + 1)
    stop = lambda k: F.when(k == size, F.size(split)).otherwise(F.element_at(F.col(at), k + 1))
    pieces = F.transform(F.sequence(F.lit(0), size), lambda k: F.slice(split, start(k) + 1, stop(k) - start(k)))
    return out.withColumns({
        n_lines: F.size(split).cast("long"),
        n_dropped: F.coalesce(size, F.lit(0)).cast("long"),
        kept: F.when(F.col(at).isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n")),
    }).drop(mark, key, at, "g_doc", "g_row")

