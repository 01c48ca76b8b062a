"""Phrases whose words stay together, mined with count automata.

Each task counts the word sequences of its documents in shards, sorts them and builds a count
automaton for every prefix range (a range of the hash of language and first two words) that they
touch. The task that owns a range unions the shards' automata, sums the weights and drops what stays
below the smallest count. The parts of a phrase are looked up by composition: the owner of a range
sends the parts it needs to the ranges that own them, each once; there they become an automaton that
is composed with the counts, and the counts go back to who asked.

Counting goes in three passes, as a part is never rarer than the whole: words, then pairs of
frequent words, then sequences of three and four whose pairs are all frequent. Between passes a bit
array of ``FILTER_BITS`` bits tells what was frequent. It has that size for any corpus; a bit that is
set by another sequence lets some more rare ones be counted, and changes no result.

Rows: a null text has no word, a null language is ``und``; repeated rows and rows with null ids all
count. No rows give no phrases. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clientele.llm.common import stage
from clientele.llm.count_automata import (
    CountAutomaton, compose, distinct_rows, from_ranked, from_rows, union)

MIN_COUNT = 30
MAX_WORDS = 4
COVER_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
#: Bits of the filter between passes: 16 MB, whatever the corpus.
FILTER_BITS = 27
SHARD_WORDS = 2_500_000
_CHUNK_BYTES = 4 << 20
_UNION_ROWS = 400_000
_BLOCK = 16  # low bits of a filter slot

_STOP = 0xFF  # in no UTF-8 text
_FOLD = bytes(_STOP if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c
              for c in range(256))
_BLOB = "rng int, lang string, n int, blob binary"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with a stop between pieces."""
    return text.translate(_FOLD).replace(b"\xff", b" \xff ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\xff" + word, 42)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


class Gate:
    """Which hashes may be frequent."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.shift = 0 if bits is None else 65 - (8 * len(bits)).bit_length()

    def passes(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        slot = (h >> np.uint64(self.shift)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    def passes_one(self, h: int) -> bool:
        slot = h >> self.shift
        return self.bits is None or bool(self.bits[slot >> 3] >> (slot & 7) & 1)


class _Vocabulary(dict):
    """Numbers of the words seen, from 1; a word that is not frequent is 0, as a stop is."""

    def __init__(self, lang: str, gate: Gate):
        super().__init__({b"\xff": 0})
        self.lang, self.gate = lang, gate
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        if not self.gate.passes_one(h):
            self[word] = 0
            return 0
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return number


class _Shard:
    """Word numbers of one language until it is counted."""

    def __init__(self, lang: str, gate: Gate):
        self.known = _Vocabulary(lang, gate)
        self.parts: list[np.ndarray] = []
        self.size = self.words = 0

    def add(self, texts: list[bytes]) -> None:
        found = tokens(b"\xff".join(texts))
        ids = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        self.words += len(found) - found.count(b"\xff")
        self.parts.append(np.append(ids, 0))
        self.size += len(ids) + 1

    def automata(self, widths: tuple[int, ...], pairs: Gate, n_ranges: int) -> Iterator[tuple[int, int, bytes]]:
        """(range, width, packed automaton) of all sequences of the given widths."""
        ids = np.concatenate([*self.parts, np.zeros(MAX_WORDS, np.int64)])
        base = len(self.known.words)
        order = [0, *sorted(range(1, base), key=self.known.words.__getitem__)]
        rank = np.empty(base, np.int64)
        rank[order] = np.arange(base)
        ids, words = rank[ids], [self.known.words[i] for i in order]
        hashes = np.array(self.known.hashes, np.uint64)[order]
        full = ids > 0
        near = None
        for n in widths:
            at = full[:len(ids) - n + 1].copy()
            for k in range(1, n):
                at &= full[k:len(ids) - n + 1 + k]
            if n > 2:
                if near is None:
                    near = pairs.passes(pair_hash(hashes[ids[:-1]], hashes[ids[1:]]))
                for k in range(n - 1):
                    at &= near[k:len(ids) - n + 1 + k]
            at = np.flatnonzero(at)
            if not len(at):
                continue
            columns = [ids[at + k] for k in range(n)]
            first, _, count = distinct_rows(columns, base)
            columns = [c[first] for c in columns]
            lead = hashes[columns[0]] if n == 1 else pair_hash(hashes[columns[0]], hashes[columns[1]])
            owner = _ranges(lead, n_ranges)
            dealt = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[dealt], np.arange(n_ranges + 1))
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                own = dealt[bounds[r]:bounds[r + 1]]
                yield r, n, from_ranked(words, [c[own] for c in columns], count[own]).pack()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))


def _count(rows: DataFrame, widths: tuple[int, ...], words, pairs, n_ranges: int) -> DataFrame:
    """Packed shard automata; rows of width 0 hold the number of words as text."""
    def run(batches):
        gates = [Gate(None if b is None else np.frombuffer(b.value, np.uint8)) for b in (words, pairs)]
        shards: dict[str, _Shard] = {}

        def flush(lang):
            shard = shards.pop(lang)
            made = list(shard.automata(widths, gates[1], n_ranges))
            made.append((0, 0, str(shard.words).encode()))
            return pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int32()), pa.array([lang] * len(made), pa.string()),
                 pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())],
                ["rng", "lang", "n", "blob"])

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                held, size = [], 0
                for text in batch.column(1).filter(pc.equal(langs, lang)):
                    held.append(text.as_py())
                    size += len(held[-1])
                    if size >= _CHUNK_BYTES:
                        shards.setdefault(lang, _Shard(lang, gates[0])).add(held)
                        held, size = [], 0
                shards.setdefault(lang, _Shard(lang, gates[0])).add(held)
            for lang in [k for k, s in shards.items() if s.size >= SHARD_WORDS]:
                yield flush(lang)
            while sum(s.size for s in shards.values()) >= 2 * SHARD_WORDS:
                yield flush(max(shards, key=lambda k: shards[k].size))
        for lang in list(shards):
            yield flush(lang)

    return rows.mapInArrow(run, _BLOB)


def _union(shards: DataFrame, n_ranges: int, least: int, name: str) -> DataFrame:
    """A staged table with one automaton for each range, language and width."""
    def run(batches):
        key, held, size = None, [], 0

        def merge():
            nonlocal held, size
            held = [union(held)]
            size = 0

        def closed():
            done = union(held, least)
            if not len(done.label[-1]):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([key[2]], pa.int32()),
                 pa.array([done.pack()], pa.binary())], ["rng", "lang", "n", "blob"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if held and (out := closed()):
                        yield out
                    key, held, size = row[:3], [], 0
                held.append(CountAutomaton.unpack(row[3]))
                size += len(held[-1].label[-1])
                # The merged part grows; adding up shards as large as it keeps the work in proportion.
                if size > max(_UNION_ROWS, len(held[0].label[-1])):
                    merge()
        if held and (out := closed()):
            yield out

    keys = ["rng", "lang", "n"]
    owned = shards.where("n > 0").repartition(n_ranges, "rng").sortWithinPartitions(*keys)
    return stage(owned.mapInArrow(run, _BLOB), name)


def _filter(automata: DataFrame) -> object:
    """A broadcast bit array of the hashes of all sequences of one or two words in ``automata``."""
    def slots(batches):
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = CountAutomaton.unpack(blob)
                h = np.array([word_hash(lang, w) for w in found.symbols], np.uint64)
                columns, _ = found.rows()
                h = h[columns[0]] if len(columns) == 1 else pair_hash(h[columns[0]], h[columns[1]])
                slot = np.unique(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64())], ["slot"])

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _BLOCK, np.uint8)
        bits[pdf["slot"].to_numpy() & ((1 << _BLOCK) - 1)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pd.DataFrame({"block": pdf["block"][:1], "bits": [zstandard.ZstdCompressor().compress(packed)]})

    slot = automata.select("lang", "blob").mapInArrow(slots, "slot long").distinct()
    made = (slot.withColumn("block", F.shiftright("slot", _BLOCK)).groupBy("block")
            .applyInPandas(blocks, "block long, bits binary"))
    whole = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for r in made.toLocalIterator():  # 2 ** (FILTER_BITS - 16) rows of 8 KB at most
        whole[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8)
    return automata.sparkSession.sparkContext.broadcast(whole.tobytes())


def _parts(automata: DataFrame, n_ranges: int) -> DataFrame:
    """(rng, back, lang, n, part): what the owners of ``back`` ask the owners of ``rng``, each part once."""
    def run(batches):
        for batch in batches:
            for back, lang, _, blob in zip(*(c.to_pylist() for c in batch.columns)):
                found = CountAutomaton.unpack(blob)
                columns, _ = found.rows()
                width = len(columns)
                h = np.array([word_hash(lang, w) for w in found.symbols], np.uint64)
                for n in range(1, width):
                    part = [np.concatenate(c) for c in zip(columns[:n], columns[width - n:])]
                    first, _, _ = distinct_rows(part, max(1, len(found.symbols)))
                    part = [c[first] for c in part]
                    lead = h[part[0]] if n == 1 else pair_hash(h[part[0]], h[part[1]])
                    text = [b" ".join(w) for w in zip(*[[found.symbols[i] for i in c.tolist()] for c in part])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_ranges(lead, n_ranges), pa.int32()), pa.array([back] * len(text), pa.int32()),
                         pa.array([lang] * len(text), pa.string()), pa.array([n] * len(text), pa.int32()),
                         pa.array(text, pa.binary())], ["rng", "back", "lang", "n", "part"])

    return automata.where("n > 1").mapInArrow(run, "rng int, back int, lang string, n int, part binary")


def _answers(automata: DataFrame, asked: DataFrame) -> DataFrame:
    """(rng, lang, part, f): the parts that ``rng`` asked for, with their counts."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["rng", "lang", "part", "f"], dtype=object)
        counts = CountAutomaton.unpack(left["blob"].iloc[0])
        code, parts = pd.factorize(right["part"])
        words: dict[bytes, int] = {}
        rows = [[words.setdefault(w, len(words)) for w in p.split(b" ")] for p in parts]
        columns = [np.array(c, np.int64) for c in zip(*rows)]
        found = compose(from_rows(list(words), columns, np.ones(len(rows), np.int64)), counts)
        at, weight = found.rows()
        named = zip(*[[found.symbols[i] for i in c.tolist()] for c in at])
        known = dict(zip(map(b" ".join, named), weight.tolist()))
        f = np.array([known[p] for p in parts], np.int64)
        return pd.DataFrame({"rng": right["back"].tolist(), "lang": right["lang"].tolist(),
                             "part": right["part"].tolist(), "f": f[code].tolist()})

    keys = ["rng", "lang", "n"]
    return automata.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        run, "rng int, lang string, part binary, f long")


def _cuts(automata: DataFrame, answers: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) of every phrase of two words or more, at its lowest cut."""
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(right["part"], right["f"].tolist()))
        out = []
        for blob in left["blob"]:
            found = CountAutomaton.unpack(blob)
            columns, weight = found.rows()
            for *at, a in zip(*[c.tolist() for c in columns], weight.tolist()):
                words = [found.symbols[i] for i in at]
                cuts = [(known[b" ".join(words[:k])], known[b" ".join(words[k:])]) for k in range(1, len(words))]
                score, _, (part, rest) = min((SCALE * a // (x + y), k, (x, y)) for k, (x, y) in enumerate(cuts))
                out.append((key[1], len(words), b" ".join(words), a, part, rest, score))
        return pd.DataFrame(out, columns=["lang", "n_words", "phrase", "a", "l", "r", "score"])

    keys = ["rng", "lang"]
    schema = "lang string, n_words int, phrase binary, a long, l long, r long, score long"
    found = automata.where("n > 1").groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInPandas(run, schema)
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def _uncovered(found: DataFrame, percent: int) -> DataFrame:
    """Phrases without those that lie in a longer one which is nearly as frequent."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))))
    inner = (found.where("n_words > 2").withColumn("w", words).select("lang", F.explode(spans).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("outer_a")))
    wide = "decimal(38,0)"
    covered = F.lit(100).cast(wide) * F.col("outer_a") >= F.lit(percent).cast(wide) * F.col("a")
    return found.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("outer_a")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    A phrase has two to four words within a piece (text between ``.,;:!?`` and line breaks) and
    occurs ``min_count`` times or more; ``l`` and ``r`` are the counts of the two parts of the cut with
    the lowest score ``SCALE * a // (l + r)``, the shortest first part among equals.
    """
    spark: SparkSession = docs.sparkSession
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _rows(docs, text_col, lang_col)
    first = stage(_count(rows, (1,), None, None, n_ranges), "words")
    totals = (first.where("n = 0").groupBy("lang")
              .agg(F.sum(F.col("blob").cast("string").cast("long")).alias("n")))
    ones = _union(first, n_ranges, min_count, "words")
    words = _filter(ones)
    twos = _union(_count(rows, (2,), words, None, n_ranges), n_ranges, min_count, "pairs")
    pairs = _filter(twos)
    more = _union(_count(rows, tuple(range(3, MAX_WORDS + 1)), words, pairs, n_ranges),
                  n_ranges, min_count, "phrases")
    automata = ones.union(twos).union(more)
    answers = _answers(automata, _parts(automata, n_ranges))
    found = stage(_cuts(automata, answers), "cuts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = _uncovered(found, percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l",
                                              "r", "n", "score")
