"""Token ids in segments of separately compressed documents with one shared dictionary.

The file format: a folder with three Parquet tables. ``segments`` has a row per segment, in
ascending order of documents: ``part`` and ``seq`` (its place), ``n_docs``, ``n_ids``, ``first_doc``
and ``last_doc``, ``local_start`` (ids before it within its part), ``width`` (bytes per id),
``dict_hash``, ``index`` and ``payload``. The payload is a zstandard frame per document; the index
is little-endian 64-bit numbers, for each document its id (the smallest number: null), the offset of
its frame and its number of ids. ``parts`` has the ids before each part, ``dictionary`` the dictionary
and its SHA-256. One document is read by its segment's statistics, one index entry and one frame.

Everything is written by Spark's own committed writers, so a lost executor leaves no half file and
any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clientele.llm.common import shared_folder, stage

END_ID = 2
SEGMENT_IDS = 1 << 20
DICT_BYTES = 64 << 10
#: Documents the dictionary is trained on, about, and the bytes of the window of serialized ids taken from
#: each, at a place that the document's hash names; no other step samples.
DICT_DOCS, DICT_WINDOW = 1500, 6144
LEVEL = 3
NO_DOC = -(1 << 63)
# A task keeps so many words and word stems, about 200 MB.
_CACHED_WORDS = 700_000
_CACHED_STEMS = 250_000
_CHUNK_CHARS = 4_000_000
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_CLOSING = b".,;:!?%$&#*|()\"/-"
# Texts that show whether a tokenizer goes by words.
_PROBES = ("Zum Beispiel: A-b, c.d (e)!", "  two  spaces\tand\n\nlines \x0b\x0c\r", "Été ÀÇ naïve 12,5 % x_y ß Ω", "$1.00; \"q\"")


class WordEncoder:
    """Ids of whole texts by a tokenizer that never merges across ASCII white space.

    Such a tokenizer gives a text the ids of its words in order, so each word is encoded once and
    kept. A word of Latin-1 letters with closing punctuation is what the tokenizer's own splitter
    cuts into letters and punctuation, which go straight to its model; every other word takes the
    tokenizer's whole way. The tests compare with encoding whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        letters = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = str.maketrans({c: split(c)[0][0] for c in letters})  # how the model spells them
        self.bytes_per_id = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.forget()
        self._check()

    def _check(self) -> None:
        """Raise if words one by one do not give a text's ids."""
        for text in _PROBES:
            if list(next(self.encode([text]))) != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("the tokenizer does not lower-case and split at white space: encode whole texts instead")

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}  # what stands before white space that begins a text
        self.stems: dict[bytes, list[int]] = {}
        self.marks: dict[bytes, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _part(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(part.translate(self.spelled))]

    def _stems_of(self, stems: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of stems of letters; other stems are left out. ASCII letters the model spells as they are."""
        split, out = self.tokenizer.model.tokenize, {}
        for s in stems:
            if s.isalpha():
                out[s] = [t.id for t in split(s.decode())]
            elif _LETTERS.fullmatch(text := s.decode()):
                out[s] = self._part(text.lower())
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, sizes, made = self.known, [], []
        new = [w for w in dict.fromkeys(words) if w not in known]
        bare = [w.rstrip(_CLOSING) for w in new]
        stems = [b.lower() for b in bare]  # ASCII letters; the tokenizer does the others
        found = self._stems_of([s for s in dict.fromkeys(stems) if s not in self.stems])
        if len(self.stems) < _CACHED_STEMS:
            self.stems.update(found)
            found = self.stems
        else:
            found |= {s: self.stems[s] for s in stems if s in self.stems}
        for w, b, stem in zip(new, bare, stems):
            known[w] = len(known)
            ids = found.get(stem)
            if ids is None:
                ids = self.tokenizer.encode(w.decode(), add_special_tokens=False).ids
            elif len(b) < len(w):
                rest = w[len(b):]
                marks = self.marks.get(rest)
                if marks is None:
                    marks = self._part(rest.decode())
                    if len(self.marks) < _CACHED_STEMS:
                        self.marks[rest] = marks
                ids = ids + marks
            sizes.append(len(ids))
            made += ids
        n, used = len(known), self.used + len(made)
        while n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:used] = made
        self.length[n - len(sizes):n] = sizes
        self.start[n - len(sizes):n] = self.used + np.cumsum([0, *sizes])[:-1]
        self.used = used

    def _chunk(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = lists.flatten().dictionary_encode()  # each different word is looked up once
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        get = self.known.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self._learn(unknown)
            at[new] = np.fromiter(map(get, unknown), np.int64, len(unknown))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[at]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        take = np.repeat(self.start[at] - upto[:-1], lengths) + np.arange(upto[-1])
        ids = self.ids[take]
        offsets = lists.offsets.to_numpy()
        bounds = upto[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        held: list[str | None] = []
        n = 0
        for text in texts:
            held.append(text)
            n += len(text) if text else 0
            if n >= _CHUNK_CHARS:
                yield from self._chunk(held)
                held, n = [], 0
                if len(self.known) > _CACHED_WORDS:
                    self.forget()
        yield from self._chunk(held)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One tokenizer for each worker process; a task forgets its words when it ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> bytes:
    """A dictionary from the serialized ids of a sample: about DICT_DOCS rows, chosen by the hash of their ids.

    Rows that share an id count once. Too little data for a dictionary gives an empty one: frames
    then stand alone.
    """
    n = docs.count()
    mark = F.xxhash64(F.col(id_col))
    rows = (docs.where(F.pmod(mark, F.lit(max(1, n // DICT_DOCS))) == 0)
            .select(mark.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
            .dropDuplicates(["h"]))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            made = []
            for h, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                raw = _serialize(ids, enc.bytes_per_id, end_id)
                spare = max(0, len(raw) - DICT_WINDOW) // enc.bytes_per_id
                at = h % (spare + 1) * enc.bytes_per_id
                made.append(raw[at:at + DICT_WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])
        enc.forget()

    arrays = [bytes(r[0]) for r in rows.mapInArrow(run, "ids binary").collect()]  # bounded, see above
    total = sum(map(len, arrays))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, total // 8)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _serialize(ids: np.ndarray, width: int, end_id: int) -> bytes:
    return np.append(ids, end_id).astype(f"<u{width}").tobytes()


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts and write them to a new ``folder`` in ascending order of ids, nulls last.

    A null text is empty: its document holds the end id only. Rows that share an id are all kept,
    ordered by what they hold.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, id_col, text_col, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    (spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary")
     .coalesce(1).write.parquet(f"{folder}/dictionary"))

    def compress(batches):
        enc = encoder(path)
        one = _compressor(dictionary)
        for batch in batches:
            sizes, sums, frames = [], [], []
            for ids in enc.encode(batch.column(1).to_pylist()):
                raw = _serialize(ids, enc.bytes_per_id, end_id)
                sizes.append(len(ids) + 1)
                sums.append(zlib.crc32(raw))
                frames.append(one.compress(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(frames, pa.binary()), pa.array([enc.bytes_per_id] * len(sizes), pa.int32())],
                ["doc", "n", "crc", "frame", "width"])
        enc.forget()

    frames = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    frames = stage(frames.mapInArrow(compress, "doc long, n long, crc long, frame binary, width int"), "frames")
    order = [F.col("doc").asc_nulls_last(), F.col("n"), F.col("crc")]
    ranged = frames.repartitionByRange(*order).sortWithinPartitions(*order)

    def assemble(batches):
        seq = start = 0
        held: list[tuple] = []

        def segment():
            nonlocal seq, start, held
            ids = np.array([NO_DOC if r[0] is None else r[0] for r in held], "<i8")
            sizes = np.array([r[1] for r in held], "<i8")
            offsets = np.concatenate(([0], np.cumsum([len(r[2]) for r in held])[:-1])).astype("<i8")
            named = [r[0] for r in held if r[0] is not None]
            row = [seq, len(held), int(sizes.sum()), min(named, default=None), max(named, default=None), start,
                   held[0][3], digest, np.stack([ids, offsets, sizes], axis=1).tobytes(),
                   b"".join(r[2] for r in held)]
            seq, start, held = seq + 1, start + int(sizes.sum()), []
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        n = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(r)
                n += r[1]
                if n >= segment_ids:
                    yield segment()
                    n = 0
        if held:
            yield segment()

    names = ["seq", "n_docs", "n_ids", "first_doc", "last_doc", "local_start", "width", "dict_hash", "index", "payload"]
    schema = ("seq long, n_docs long, n_ids long, first_doc long, last_doc long, local_start long, width int, "
              "dict_hash string, index binary, payload binary")
    built = ranged.select("doc", "n", "frame", "width").mapInArrow(assemble, schema)
    built.withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    (sizes.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
     .coalesce(1).write.parquet(f"{folder}/parts"))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if not dictionary:
        return zstandard.ZstdDecompressor()
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def documents_of(index: bytes, payload: bytes, width: int, plain: zstandard.ZstdDecompressor,
                 only: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, ids of the segment before it, ids) of a segment's documents, or of some of them."""
    table = np.frombuffer(index, "<i8").reshape(-1, 3)
    stops = np.append(table[1:, 1], len(payload))
    starts = np.concatenate(([0], np.cumsum(table[:, 2])[:-1])) if len(table) else []
    view = memoryview(payload)
    for (doc, offset, n), stop, start in zip(table.tolist(), stops.tolist(), np.asarray(starts).tolist()):
        if only is None or doc in only:
            ids = np.frombuffer(plain.decompress(view[offset:stop]), f"<u{width}")
            if len(ids) != n:
                raise ValueError(f"document {doc} has {len(ids)} ids, its index says {n}")
            yield None if doc == NO_DOC else doc, start, ids


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, bytes]]:
    kept = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    for name, data in kept.items():
        if hashlib.sha256(data).hexdigest() != name:
            raise ValueError(f"dictionary {name} is damaged")
    segments = spark.read.parquet(f"{folder}/segments")
    return segments.join(F.broadcast(spark.read.parquet(f"{folder}/parts")), "part"), kept


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    segments, kept = _opened(spark, folder)

    def run(batches):
        plain = {k: _decompressor(v) for k, v in kept.items()}
        for batch in batches:
            for index, payload, width, name, first in zip(*(c.to_pylist() for c in batch.columns)):
                docs, starts, sizes, sums = [], [], [], []
                for doc, start, ids in documents_of(index, payload, width, plain[name]):
                    docs.append(doc)
                    starts.append(first + start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (docs, starts, sizes, sums)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = segments.select("index", "payload", "width", "dict_hash",
                           (F.col("part_start") + F.col("local_start")).alias("first"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: only the segments that span them, only their frames."""
    segments, kept = _opened(spark, folder)
    wanted = set(doc_ids)
    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def run(batches):
        plain = {k: _decompressor(v) for k, v in kept.items()}
        for batch in batches:
            found = [(doc, ids.tolist()) for index, payload, width, name in zip(*(c.to_pylist() for c in batch.columns))
                     for doc, _, ids in documents_of(index, payload, width, plain[name], wanted)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()),
                                              pa.array([i for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return segments.where(near).select("index", "payload", "width", "dict_hash").mapInArrow(
        run, "doc_id long, ids array<long>")


def encode_to_store(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to ``folder`` (a new one in the shared folder by default) and read it back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    write(docs, folder, path, **options)
    return read(spark, folder)
