import math
import random

import duckdb
import public_tokenizers
import pytest
from test_mixing import mixing
from test_quality import plain_base, plain_model, symbols
from test_secrets import plain, plain_redact
from test_simhash import plain_components, plain_tables
from tokenizers import Tokenizer

import corpus_pipeline
from parley.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component long"


def corpus():
    rng = random.Random(10)
    bits = {"en": ["the ", "ing ", "and ", "ar", "on"], "de": ["der ", "ung ", "ein", "ß "]}
    rows = [(0, None, "en", "a"), (1, "", "de", "b"), (2, "too short", "en", None)]
    for i in range(3, 160):
        lang = rng.choice(["en", "en", "de"])
        text = "".join(rng.choice(bits[lang]) for _ in range(rng.randint(60, 250)))
        if i % 40 == 0:
            text = "".join(rng.choice("QXZ|# ") for _ in range(400))
        if i % 11 == 0:
            text += ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" tail'
        rows.append((i, text, lang, rng.choice(["hot", "hot", "s1", "s2"])))
        if i % 9 == 0:
            rows.append((1000 + i, text + (" more" if i % 2 else ""), lang, "s1"))
    rows += [rows[20], rows[20], (None, rows[30][1], "en", "hot"), (None, rows[31][1][::-1], "de", "hot")]
    return [(i, t, lang, s, len(t or ""), True, 3) for i, t, lang, s in rows]


def plain_quality(rows):
    out = set()
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        score = plain_model([r[1] for r in own])
        size = [len(symbols(r[1])) + 1 for r in own]
        levels = [-score(r[1]) / n for r, n in zip(own, size)]
        bins = sorted(math.floor(x / 0.001 + 0.5) for x in levels)
        middle = bins[(len(bins) - 1) // 2]
        half = 5.5 * max(1, sorted(abs(b - middle) for b in bins)[(len(bins) - 1) // 2])
        for row, level, n in zip(own, levels, size):
            words, _, _, _, repeated = plain_base(row[1])
            drawn = (level * n + middle * 0.001 * 100) / (n + 100)
            if words >= 10 and 100 * repeated <= 20 * words and abs(drawn - middle * 0.001) <= half * 0.001:
                out.add(row)
    return [r for r in rows if r in out]


def plain_dedup(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    tables, longer = ([plain_tables(r[1], *of) for r in rows] for of in ((2, 0, 8), (5, 8, 8)))
    bits = lambda a, b: [(x ^ y).bit_count() for x, y in zip(a, b)]
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if min(bits(tables[i], tables[j])) <= 4 and sum(bits(longer[i], longer[j])) <= 85]
    group = plain_components(near, range(len(rows)))
    return [r for i, r in enumerate(rows) if group[i] == i]


def plain_secrets(rows):
    out = []
    for i, text, *rest in rows:
        clean = plain_redact(text) if plain(text) else text
        out.append((i, clean, *rest[:2], len(clean), *rest[3:]))
    return out


def plain_mix(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    sampled = {r[0] for r in con.execute(mixing.sql(mixing.Mix(budget=corpus_pipeline.BUDGET))).fetchall() if r[5]}
    return [r for r in rows if r[0] in sampled]


def test_every_stage_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = docs.columns
    for (name, stage), model in zip(corpus_pipeline.STAGES, (plain_quality, plain_dedup, plain_secrets, plain_mix)):
        before = len(rows)
        docs, rows = stored(stage(spark, docs, ""), name), model(rows)
        assert docs.columns == names
        got = [tuple(r) for r in docs.collect()]
        assert sorted(map(str, got)) == sorted(map(str, rows)), name
        assert rows and (len(rows) < before or name == "secret_scan")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in rows}
    last = corpus_pipeline.word_bpe(spark, docs, "").collect()
    assert len(last) == len(rows)
    for r in last:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    got = corpus_pipeline.run(spark, f"/root/testdata/{sf}")
    assert 20 < got.count() < 200


def test_columns_named_like_the_operators_own(spark):
    """Columns of such names come through every stage with their values."""
    names = ["_row", "_key", "_print", "_size", "_tokens", "_topic", "_cuts", "_id", "_sampled", "shielded0"]
    given = [(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(corpus())]
    docs = spark.createDataFrame(given, SCHEMA + "".join(f", {c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == [*[c.split()[0] for c in SCHEMA.split(", ")], *names]
    rows = docs.collect()
    assert rows
    for r in rows:
        number = r["_row"].removeprefix("_row")
        assert all(r[c] == c + number for c in names)
        assert given[int(number)][0] == r.doc_id


def test_near_dedup_links_fingerprints_too(spark):
    """Texts of one fingerprint whose shingle sets are less alike are near duplicates; so is what either side links."""
    rng = random.Random(3)
    line, words = "the quick brown fox jumps over it " * 60, [f"w{k}" for k in range(100)]
    a, b = (line + " ".join(rng.sample(words, 6)) for _ in range(2))
    long = " ".join(rng.choice(words) for _ in range(300))
    texts = [b + " end", long, a, "alone " + " ".join(words), long + " more", b, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 3) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 3, 6]
