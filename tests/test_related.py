"""Similar documents by blocks of queries and documents, against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import lists
from parley.operators import search as s

ASKED = pa.list_(pa.struct([("term", pa.string()), ("boost", pa.float64()), ("idf", pa.float64()), ("heavy", pa.bool_())]))
HELD = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))


def order(found):
    return sorted(found, key=lambda d: (-round(found[d][0], 6), found[d][1] is None, -(found[d][1] or 0), d))


@pytest.mark.parametrize("seed", range(12))
def test_block_like_brute_force(seed, monkeypatch):
    """Ties, null votes, documents that come twice, terms that nobody holds; lists read in steps and whole."""
    rng = random.Random(seed)
    monkeypatch.setattr(lists, "CELLS", rng.choice([50, 500, 2_000_000]))
    terms = [f"t{i}" for i in range(12)]
    idf = {t: rng.choice([1.0, 1.5, 2.25]) for t in terms}
    heavy = {t: rng.random() < 0.7 for t in terms}
    queries = [(rng.choice("ab"), f"q{i}", {t: rng.choice([1.0, 0.5, 0.3]) for t in rng.sample(terms, 4)}) for i in range(20)]
    docs = [(rng.choice("ab"), i, rng.choice([None, 0, 1, 2]), [(t, rng.randint(1, 3)) for t in rng.sample(terms[1:], 5)])
            for i in range(40)]
    docs.append(docs[3])
    asked = pa.table({"owner": [q[0] for q in queries], "_q": [q[1] for q in queries], "_terms": pa.array(
        [[{"term": t, "boost": b, "idf": idf[t], "heavy": heavy[t]} for t, b in q[2].items()] for q in queries], ASKED)})
    held = pa.table({"owner": [d[0] for d in docs], "id": [d[1] for d in docs], "votes": pa.array([d[2] for d in docs], pa.int64()),
                     "_terms": pa.array([[{"term": t, "tf": n} for t, n in d[3]] for d in docs], HELD)})
    want = []
    for owner, name, boosts in queries:
        found = {}
        for own, d, votes, counts in docs:
            for t, n in counts:
                if own == owner and t in boosts:
                    found.setdefault(d, [0.0, votes])[0] += boosts[t] * (n * idf[t])
        want += [(owner, name, d, round(found[d][0], 6), found[d][1]) for d in order(found)[:4]]
    got = lists.best_of_block(asked, held, ["owner"], "id", 4, rng.choice([1, 3, 998])).to_pylist()
    key = lambda r: (*r[:4], str(r[4]))
    assert sorted([(r["owner"], r["_q"], r["id"], r["score"], r["votes"]) for r in got], key=key) == sorted(want, key=key)


def test_rounding_like_spark(spark):
    numbers = [0.0000005, 1.0000005, 2.5, 0.1234565, 1.1234575, 7.0000025, 12345.6789015, 1 / 3, 0.0, 99.9999995]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(F.round("x", 6).alias("r")).collect()
    assert [k / 1e6 for k in lists.rounded(np.array(numbers))] == [r.r for r in rows]


@pytest.mark.parametrize("limits", [{}, {"light_df": 0, "depth": 1}, {"start": 1}])
def test_related_meets_in_blocks(spark, monkeypatch, limits):
    """A term that all documents hold: no pair of a query and a document is shuffled, and small scopes share a task."""
    for name, most in (("BLOCK_DOCS", 16), ("BLOCK_ENTRIES", 40), ("BLOCK_QUERIES", 8)):
        monkeypatch.setattr(s, name, most)
    rng = random.Random(3)
    tf, docs = [], []
    for d in range(150):
        scope = ("big", "x") if d < 90 else (rng.choice("opq"), rng.choice("xy"))
        docs.append((d, *scope, rng.choice([None, 0, 1])))
        tf += [(d, *scope, t, rng.randint(1, 3)) for t in ["the", *rng.sample("abcdefgh", 3)]]
    queries = [(d, o, a, t, n / 4) for d, o, a, t, n in tf]
    stats = spark.createDataFrame(tf, "conv_id long, owner string, area string, term string, tf long").groupBy(
        "owner", "term").agg(F.count("*").alias("df"))
    found = s.related(
        spark.createDataFrame(queries, "conv_id long, owner string, area string, term string, boost double"),
        spark.createDataFrame(tf, "conv_id long, owner string, area string, term string, tf long"),
        spark.createDataFrame(docs, "conv_id long, owner string, area string, votes long"), stats, F.lit(150),
        ["owner", "area"], "conv_id", **limits)
    assert "CoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    idf = {(r.owner, r.term): 1 + math.log(151 / (r.df + 1)) for r in stats.collect()}
    votes, own = {d: v for d, _, _, v in docs}, {d: (o, a) for d, o, a, _ in docs}
    by_doc = {}
    for d, o, a, t, n in tf:
        by_doc.setdefault(d, {})[t] = n
    skip, want = limits.get("start", 0), []
    for q in by_doc:
        scores = {}
        for d in by_doc:
            common = set(by_doc[q]) & set(by_doc[d]) if own[q] == own[d] and d != q else ()
            if common:
                scores[d] = sum(by_doc[q][t] / 4 * (by_doc[d][t] * idf[own[d][0], t]) for t in sorted(common)), votes[d]
        want += [(q, n, d, round(scores[d][0], 6), votes[d]) for n, d in enumerate(order(scores)[:skip + 3], 1) if n > skip]
    got = [(r.query_id, r["rank"], r.conv_id, r.score, r.votes) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
