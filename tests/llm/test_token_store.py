"""The token files against encoding whole texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientele.llm import token_store
from clientele.llm.common import shared_folder
from clientele.llm.queries_tokens import tokenizer_path
from clientele.llm.token_store import WordEncoder, documents_of, lookup, read, write

ODD = ["", "don't can’t I'll 'stand 's", "ﬁne ½ été ́abc İstanbul ΣΑΣ ς", "<|endoftext|> a<|startoftext|>b",
       "x\x1cy a b \x85c", "ªº µm ÀÉÎ ß ẞ", "a1b2 3.14 (hello) \"quoted\" rock'n'roll", "日本語 テスト ไทย",
       "word... really?! a--b a/b 100%%% x&&& y*** z$$$ ###", "naïve,façade;Ünïcödé... ÿ", "​zero﻿",
       "a_b __x__ 'tis (a) /b- c/ \"", "\t\n\x0b ", "é Ë. K å", "a" * 3000, "the " * 3000]


@pytest.fixture(scope="module")
def direct():
    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_the_whole_text(spark, direct, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    monkeypatch.setattr(token_store, "_CHUNK_CHARS", 30_000)
    monkeypatch.setattr(token_store, "_CACHED_WORDS", 3000)
    got = [ids.tolist() for ids in WordEncoder(tokenizer_path()).encode(texts)]
    assert got == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark, direct):
    texts = [*ODD, None]
    rows = [(10 * i % 37, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "same id"), (3, "same id"), (3, "a b")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, n string").repartition(4)
    folder = shared_folder(spark, "test-tokens")
    write(docs, folder, tokenizer_path(), segment_ids=500)
    got = [tuple(r) for r in read(spark, folder).orderBy("start").collect()]
    encoded = [(d, [*direct.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    last = max(d for d, _ in rows if d is not None) + 1
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((last if d is None else d, n, c) for d, _, n, c in got) == sorted(
        (last if d is None else d, len(ids), crc(ids)) for d, ids in encoded)
    start = 0
    for (d, s, n, _), after in zip(got, [*got[1:], None]):
        assert s == start and (after is None or after[0] is None or d <= after[0])
        start += n
    segments = spark.read.parquet(f"{folder}/segments").collect()
    assert len(segments) > 2 and len({s["dict_hash"] for s in segments}) == 1
    found = {r["doc_id"]: r["ids"] for r in lookup(spark, folder, [rows[6][0], 999]).collect()}
    assert found == {rows[6][0]: encoded[6][1]}


def test_a_damaged_index_is_noticed():
    one = token_store._compressor(b"")
    frame = one.compress(np.array([1, 2], "<u2").tobytes())
    index = np.array([[5, 0, 3]], "<i8").tobytes()
    with pytest.raises(ValueError):
        list(documents_of(index, frame, 2, token_store._decompressor(b"")))


def test_dictionary_is_used_and_named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = shared_folder(spark, "test-tokens")
    write(docs, folder, tokenizer_path())
    row = spark.read.parquet(f"{folder}/dictionary").first()
    assert len(row["dictionary"]) > 256
    assert spark.read.parquet(f"{folder}/segments").where(F.col("dict_hash") != row["dict_hash"]).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.encode_to_store(docs, tokenizer_path()).count() == 0


def test_a_tokenizer_that_does_not_go_by_words_is_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    whole = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1}, unk_token="[UNK]"))
    whole.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    whole.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_store.WordEncoder(str(tmp_path / "t.json"))
