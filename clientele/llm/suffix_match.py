"""Benchmark decontamination with suffix arrays over the training documents.

Every batch of documents is a shard. Its words become numbers, its suffixes are sorted by their
first words, and every suffix of every benchmark item is searched in that order by bisection. The
range found holds all places where the training text has those words; each is extended to the
longest verbatim match. A suffix of the documents only enters the array if its first words occur
somewhere in the benchmark (a table of word runs by hash tells), since no other can be found.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text: a larger one is
searched block after block, the rows written between two, so that a task holds one block only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientele.llm.common import fresh, stage

MIN_WORDS = 10
BLOCK_BYTES = 4 << 20  # measured: a worker holds 104 MB more for 4 MB of items with words of six letters
SHARD_WORDS = 2_000_000
_ANCHOR = 4  # words that decide whether a suffix enters the array
_SLOTS = 1 << 24

# A-Z to a-z; all other ASCII but digits and letters to a space. Bytes of other characters stay.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
              for c in range(256))

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_start", T.LongType()),
                      T.StructField("item_start", T.LongType()), T.StructField("n_words", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])


def fold_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _anchors(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A slot for the ``width`` words from each position on."""
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(_SLOTS - 1)).astype(np.int64)


def _keys(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` words from each position on as byte strings that sort like them."""
    words = ids[at[:, None] + np.arange(width)].astype(">u4")
    return np.ascontiguousarray(words).view(f"S{4 * width}").ravel()


class _Places:
    """The (item, place) of every occurrence of each key, in arrays."""

    def __init__(self, bounds: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.bounds, self.item, self.place = bounds, item, place

    def __getitem__(self, k: int) -> list[tuple[int, int]]:
        own = slice(self.bounds[k], self.bounds[k + 1])
        return list(zip(self.item[own].tolist(), self.place[own].tolist()))


class Block:
    """The suffixes of some benchmark items, ready to be searched in any shard."""

    def __init__(self, items: list[tuple[str, str | None]], min_words: int = MIN_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[str, np.ndarray]] = []
        for item_id, text in sorted(set(items), key=lambda x: (x[0], x[1] or "")):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in fold_words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.uint32)))
        sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([ids for _, ids in self.items]) if self.items else np.zeros(0, np.uint32)
        self.patterns = []
        widths = np.minimum(sizes, min_words)
        for width in np.unique(widths).tolist():
            which = np.flatnonzero(widths == width)
            n = sizes[which] - width + 1
            item = np.repeat(which.astype(np.uint32), n)
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
            at = starts[item] + place
            slots = np.zeros(_SLOTS, bool)
            anchor = min(_ANCHOR, width)
            slots[_anchors(flat, at, anchor)] = True
            keys = _keys(flat, at, width)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            places = _Places(np.append(first, len(keys)), item[order], place[order])
            self.patterns.append((width, anchor, slots, keys[first], places))

    def search(self, ids: np.ndarray, open_: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(position, item, place in the item, words) of every maximal match in a shard.

        ``ids`` has 0 for other words and between documents; ``open_`` how many numbered words
        follow from each position on.
        """
        for width, anchor, slots, keys, places in self.patterns:
            at = np.flatnonzero(open_ >= width)
            at = at[slots[_anchors(ids, at, anchor)]]
            if not len(at):
                continue
            own = _keys(ids, at, width)
            order = np.argsort(own, kind="stable")
            own, suffixes = own[order], at[order]
            left, right = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            hit = np.flatnonzero(right > left)
            if not len(hit):
                continue
            counts = right[hit] - left[hit]
            before = np.repeat(np.cumsum(counts) - counts, counts)
            where = suffixes[np.repeat(left[hit], counts) + np.arange(counts.sum()) - before]
            which = np.repeat(hit, counts)
            order = np.argsort(where, kind="stable")
            where, which = where[order].tolist(), which[order].tolist()
            begins: dict[tuple[int, int], list[tuple[int, int]]] = {}
            previous, last = -2, -1
            for p, k in zip(where, which):
                one = (last if p == previous + 1 else -1, k)
                if one not in begins:
                    known = set(places[one[0]]) if one[0] >= 0 else ()
                    begins[one] = [(t, i) for t, i in places[k] if (t, i - 1) not in known]
                for t, i in begins[one]:
                    rest = self.items[t][1][i:]
                    n = min(len(rest), int(open_[p]))
                    differ = np.flatnonzero(ids[p:p + n] != rest[:n])
                    yield p, t, i, int(differ[0]) if len(differ) else n
                previous, last = p, k


def match_texts(block: Block, texts: list[str | None]) -> tuple[list[int], list[list[tuple]]]:
    """Word counts and maximal matches (item_id, doc_start, item_start, n_words) of texts."""
    counts: list[int] = []
    matches: list[list[tuple]] = [[] for _ in texts]
    number = block.vocabulary.get
    # Only the numbers of a shard are kept, not its words.
    begin, parts, starts, total = 0, [], [], 0

    def flush(stop: int) -> None:
        nonlocal begin, parts, starts, total
        if block.patterns and total:
            ids = np.zeros(total + 1, np.uint32)
            for s, part in zip(starts, parts):
                ids[s:s + len(part)] = part
            n = len(ids)
            ends = np.where(ids == 0, np.arange(n), n)
            open_ = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)
            bounds = np.array(starts)
            for p, t, i, length in block.search(ids, open_):
                d = int(np.searchsorted(bounds, p, "right")) - 1
                matches[begin + d].append((block.items[t][0], p - starts[d], i, length))
        begin, parts, starts, total = stop, [], [], 0

    for j, text in enumerate(texts):
        words = fold_words(text)
        counts.append(len(words))
        if total and total + len(words) > SHARD_WORDS:
            flush(j)
        starts.append(total)
        parts.append(np.fromiter((number(w, 0) for w in words), np.uint32, len(words)))
        total += len(words) + 1
    flush(len(texts))
    return counts, matches


def spans_of(matches: list[tuple]) -> list[tuple[int, int]]:
    """The stretches of words that matches cover, joined where they touch."""
    out: list[list[int]] = []
    for start, stop in sorted((m[1], m[1] + m[3]) for m in matches):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    item = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                        F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    item = stage(item, "benchmark")
    size = item.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = item.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else item
        yield [tuple(r) for r in part.collect()]


def add_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                item_text: str = "text", min_words: int = MIN_WORDS, prefix: str = "bench",
                block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, str]:
    """``docs`` with the number of words and the verbatim matches; also the two new names.

    Words are the runs of ASCII letters and digits and of non-ASCII characters after A-Z are
    lower-cased. A match is a maximal stretch of at least ``min_words`` words, or a whole shorter
    item, that a document shares with an item. A null text has no words; items without words
    match nothing; a null item id counts as an empty one; repeated items are found once.
    """
    n_words, found = fresh(f"{prefix}_words", docs.columns), fresh(f"{prefix}_matches", docs.columns)
    spark = docs.sparkSession
    out, position = docs, docs.columns.index(text_col)
    sent = None
    for b, rows in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        if sent is not None:
            out = stage(out, "matches")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(rows)
        schema = out.schema if b else T.StructType(
            [*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(found, T.ArrayType(MATCH))])

        def run(batches, sent=sent, first=not b, names=schema.fieldNames()):
            block = Block(sent.value, min_words)
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()),
                                       ("item_start", pa.int64()), ("n_words", pa.int64())]))
            keys = [f.name for f in kind.value_type]
            for batch in batches:
                counts, matches = match_texts(block, batch.column(position).to_pylist())
                rows = [[dict(zip(keys, m)) for m in one] for one in matches]
                columns = list(batch.columns)
                if not first:
                    rows = [old + new for old, new in zip(columns.pop().to_pylist(), rows)]
                    columns.pop()
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array(rows, kind)], names)

        out = out.mapInArrow(run, schema)
    return out, n_words, found


def covered_words(matches: Column) -> Column:
    """How many words of the document lie in any of the matches."""
    start = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(start, zero, lambda s, m: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], m["b"]).alias("upto")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no match with any item, all columns as they were."""
    marked, n_words, found = add_matches(docs, items, text_col, **options)
    return marked.where(F.size(found) == 0).drop(n_words, found)
