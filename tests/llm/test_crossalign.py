import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import chunks, crossalign
from parley.llm.perfecthash import MinimalHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b   c", "tab\tand\nline \n next", "<|endoftext|> <s> </s><unk> <0x0A>x",
       "▁a b", "a▁ b", "a ▁", "é 你好 ½ 😀👍🏽 한국어", "a b 　c  d", "x" * 5_000, "1234567 89", "\x00 \x01a", "don't won't 'tis",
       "word " * 2_000, "dup text", "dup text", "​‍ á ́b", "\U0010ffff ", "a  b", "naïve ﬁ Ⅷ"]


def plain(texts):
    """The contract, text by text."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    shown = {s: b for b, s in enumerate(crossalign.bytebpe.byte_symbols())}

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        raw_a = [bytes(shown[c] for c in a_lib.id_to_token(i)) for i in a]
        raw_b = [bytes_b(i) for i in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        links = [(i, j) for i, (x, e) in enumerate(zip(raw_a, ends_a)) for j in range(
            int(np.searchsorted(ends_b, e - len(x), "right")), int(np.searchsorted(ends_b, e)) + 1)]
        both = sorted(set(ends_a) & set(ends_b))
        groups = [("", "")] * len(both)
        groups = ";".join(",".join(str(i) for i, e in zip(a, ends_a) if lo < e <= hi) + "|"
                          + ",".join(str(i) for i, e in zip(b, ends_b) if lo < e <= hi)
                          for lo, hi in zip([0, *both[:-1]], both)) if len(both) < 3000 else None
        found.append((a, b, len(both), [(a[i], b[j]) for i, j in links], groups))
    count = Counter(p for f in found if f for p in f[3])
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (len(f[0]), len(f[1]), f[2], len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4])
            for f in found]


def test_documents_like_the_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = ODD + [r.text if r.text is None else r.text[:6000] for r in rows]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a long").repartition(37)
    got = {r.doc_id: r for r in crossalign.aligned(docs, A, B, with_groups=True, shard_pairs=700).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6], texts[i]
        if want[6] is not None:
            assert r.groups == want[6]
            assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")


def test_forgetting_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).coalesce(1)
    want = sorted(crossalign.aligned(docs, A, B).collect())
    monkeypatch.setattr(crossalign.Chunked, "full", lambda self: len(self.known) > 10)
    found = crossalign.Chunked()
    found.known = dict.fromkeys([b"x"] * 1 + [bytes([k]) for k in range(11)], 0)
    assert found.full()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert sorted(crossalign.aligned(docs, A, B).collect()) == want


def test_every_character_beside_a_cut():
    pair, lib = crossalign.load(A, B), Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    for first in range(1, 0x3200, 64):
        texts = [f"{c}a {c}{c} b{c} c {c}" for c in map(chr, range(first, first + 64)) if c.encode("utf-8", "ignore")]
        column = pa.array(texts, pa.string())
        state = crossalign.Chunked()
        rows, counts, new = state.rows(column)
        found = crossalign.align(pair, new)
        at = np.r_[0, np.cumsum(found.n_a)]
        ends = np.r_[0, np.cumsum(counts)]
        for text, x, y in zip(texts, ends[:-1], ends[1:]):
            if found.bad[rows[x:y]].any():
                assert "▁" in text
                continue
            a = np.concatenate([found.a[at[r]:at[r + 1]] for r in rows[x:y]]).tolist()
            assert a == lib.encode(" " + text, add_special_tokens=False).ids, text


def test_cuts():
    data = np.frombuffer(b" ab c  d\n e f g", np.uint8)
    starts, counts = chunks.cuts(data, np.array([0, 8, 8, 15]))
    assert starts.tolist() == [0, 3, 8, 11, 13] and counts.tolist() == [2, 0, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000])
def test_minimal_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    own = MinimalHash.of(keys)
    assert sorted(own.number(keys).tolist()) == list(range(len(keys)))
    raw = np.frombuffer(b"".join(np.ascontiguousarray(b).tobytes() for b in own.blocks()) + b"tail", np.uint8)
    again, at = MinimalHash.read(raw)
    assert raw[at:].tobytes() == b"tail" and again.number(keys).tolist() == own.number(keys).tolist()
    assert (MinimalHash(own.sizes[:1], own.words[:int(own.sizes[:1].sum()) // 64], np.sort(keys)).number(keys) >= 0).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crossalign.aligned(none, A, B).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in crossalign.aligned(nulls, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
