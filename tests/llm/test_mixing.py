import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from parley.llm import mixing

MIX = mixing.Mix(budget=0.4, sweeps=3)


def documents():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        lang = rng.choice(["en", "en", "en", "de", None])
        n = rng.choice([0, 5, 70, 200, 900])
        word = rng.choice(["word", "word", "$%&", "12345"])
        rows.append((i, " ".join([word] * n) or rng.choice([None, "", " "]), lang, source if i % 50 else None))
    return rows + [rows[5], (None, "no key at all", "en", "hot")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_tokens int, topic int")


def test_marginals_meet_their_targets(spark):
    rows = mixing.weighed(frame(spark, documents()), mixing.Mix(sweeps=12)).collect()
    tokens = sum(r._tokens for r in rows)
    for name, power in (("source", 0.5), ("lang", 0.7), ("_topic", 0.5)):
        have, raw = defaultdict(float), defaultdict(float)
        for r in rows:
            have[r[name]] += r._tokens * r._factor
            raw[r[name]] += r._tokens
        scale = sum(t ** power for t in raw.values() if t)
        for value, t in raw.items():
            if t:
                assert abs(have[value] - t ** power / scale * tokens) < 1e-3 * tokens
    assert abs(sum(r._tokens * r._probability for r in rows) - 0.5 * tokens) < 1e-6 * tokens
    assert max(r._probability for r in rows) <= 1


def test_sql_says_the_same(spark):
    rows = documents()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = sorted(map(str, con.execute(mixing.sql(MIX)).fetchall()))
    got = sorted(str(tuple(r)) for r in mixing.report(frame(spark, rows), MIX).collect())
    assert got == want


def test_sample_keeps_columns_and_is_fair(spark):
    docs = frame(spark, documents())
    drawn = mixing.sample(docs, MIX)
    assert drawn.columns == docs.columns
    kept = {r.doc_id for r in drawn.collect()}
    chances = {r.doc_id: r.sampled for r in mixing.report(docs, MIX).collect()}
    assert kept == {k for k, s in chances.items() if s} and 50 < len(kept) < 350
    spread = spark.range(20_000).select(mixing.chance(F.col("id"), "x").alias("u")).agg(
        F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(spread[0] - 0.5) < 0.01 and 0 <= spread[1] and spread[2] < 1


def test_no_rows_and_no_tokens(spark):
    assert mixing.sample(frame(spark, []), mixing.Mix(sweeps=1)).count() == 0
    assert mixing.report(frame(spark, [(1, None, "en", "s"), (2, "", "en", "s")]), mixing.Mix(sweeps=1)).count() == 2


def test_both_ways_of_raking_agree(spark):
    cells = spark.createDataFrame([(f"s{i % 7}", f"l{i % 3}", f"t{i % 4}", 0 if i == 5 else 13 * i % 101 + 1) for i in range(50)]
                                  + [("empty", "l0", "t0", 0), ("s1", "none", "t1", 0)],
                                  "_source string, _lang string, _topic string, tokens long").groupBy(
        "_source", "_lang", "_topic").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    one, other = (sorted(map(tuple, mixing.rake(cells, mixing.Mix(), most).collect())) for most in (1 << 16, 2))
    assert [r[:4] for r in one] == [r[:4] for r in other]
    for a, b in zip(one, other):
        assert abs(a[4] - b[4]) < 1e-9 * max(1.0, b[4])
    assert mixing.rake(cells.limit(0), mixing.Mix()).count() == 0
