import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import tokenfile
from parley.llm.common import new_folder
from parley.llm.wordbpe import encoded, load, round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a\x1cb\x1d\x85c\xa0d　e", "Don't STOP''s 's it's'", "ΣΑΣ Σ İstanbul KΩ",
       "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|> y<|endoftext|>", "a" * 20_000, "ab" * 9_999 + " " + "xyz" * 5_000,
       "é é ́a 한국어 你好 ½ ² ٣ 😀👍🏽 ‍﻿", "ǅ ß ﬁ ẞ Ⅷ ⓐ ᏸ", "\x00\x01 y᠎z​",
       "123456 a1b2", "one\n\ntwo\tthree", "dup", "dup"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "last words", "y", 2)],
                                 "doc_id long, text string, ids string, start int")


def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_merges_like_the_library(spark, library):
    texts = [t or "" for t in ODD] + [r.text or "" for r in corpus(spark).collect()]
    ids, counts = load(PATH).encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for text, end, n, want in zip(texts, ends, counts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[end - n:end].tolist() == want.ids, text[:60]
        assert load(PATH).decode(ids[end - n:end]) == library.decode(want.ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    got = {r.doc_id: r for r in round_trip(rows_of(spark), PATH).collect()}
    for i, text in [*enumerate(ODD), (None, "last words")]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    with_ids = {r.doc_id: r.ids for r in encoded(rows_of(spark), PATH).collect()}
    assert with_ids[4] == library.encode(ODD[4], add_special_tokens=False).ids and with_ids[0] == []


def test_packing():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7, 300], np.uint32)
    for n in range(len(values) + 1):
        control, data = tokenfile.pack(values[:n])
        assert len(control) == (n + 3) // 4
        back = tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert back.tolist() == values[:n].tolist()


def test_files_hold_every_id_in_key_order(spark, library):
    docs = rows_of(spark).select("doc_id", "text").unionByName(
        corpus(spark).select(F.expr("doc_id + 100").alias("doc_id"), "text")).repartition(5)
    folder = new_folder(spark, "test")
    shards = tokenfile.write_token_files(docs, PATH, folder, ids_per_file=10_000)
    assert len(shards) > 3
    got = {r.doc_id: r for r in tokenfile.read_token_files(spark, folder, shards).collect()}
    at = 0
    for row in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        have = got[row.doc_id]
        assert (have.start, have.n_tokens, have.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(none, PATH).count() == 0
    assert tokenfile.written_and_read(none, PATH).count() == 0
