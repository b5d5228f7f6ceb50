import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import bytebpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a<|endoftext|>b <|endoftext|>", "don't  stop\n\n now", "é 你好 ½ 😀 ᠎​", "x" * 30_000, "\t" * 300_000 + "z",
       "word " * 9_000, "dup", "dup"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def documents(spark):
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "no key", 2), (9, "dup", 3)],
                                "doc_id long, text string, sequence_id int")
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return odd.unionByName(whole.select(F.expr("doc_id + 100").alias("doc_id"), "text", F.lit(0).alias("sequence_id")))


def test_ids_are_the_librarys(library):
    for text in [t or "" for t in ODD]:
        assert bytebpe.load(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]
    library.encode_special_tokens = True
    for text in [t or "" for t in ODD]:
        assert bytebpe.load(PATH).encode(text, special=False).tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


@pytest.mark.parametrize("capacity", [64, 1000, 2048])
def test_pieces_nearly_fill_their_share(capacity):
    for length in range(1, 3 * capacity):
        cut = packing.pieces(length, capacity)
        assert sum(cut) == length and min(cut) >= 1
        for size in cut:
            k = capacity // size
            assert size <= packing.TAIL or (capacity // k - size) * packing.WASTE <= capacity // k


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_every_id_lies_in_one_piece(spark, library, parts):
    docs = documents(spark).repartition(parts, "doc_id")
    rows = packing.pack(docs, PATH, keep_ids=True).collect()
    want = defaultdict(list)
    for row in docs.collect():
        want[row.doc_id].append([*library.encode(row.text or "", add_special_tokens=False).ids, 1])
    used, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        used[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        if len(want[doc]) == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
            assert np.frombuffer(ids, "<u4").tolist() == want[doc][0]
            assert {r.doc_tokens for r in own} == {len(want[doc][0])}
        else:
            assert sum(r.length for r in own) == sum(map(len, want[doc]))
    total = sum(r.length for r in rows)
    sizes = [sum(n for _, n in spans) for spans in used.values()]
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.02 * total


def test_sequences(spark):
    made = packing.sequences(packing.pack(documents(spark), PATH, keep_ids=True), pad_id=7).collect()
    for r in made:
        assert sum(r.lengths) == r.used <= len(r.ids)
        assert len(r.ids) == (2048 if r.used & (r.used - 1) else r.used)
        assert set(r.ids[r.used:]) <= {7}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
