import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, list string, rank int"


def plain(rows, every=100, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 4
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "l", 3) for i, v in rows], SCHEMA)


def test_exact_where_all_lists_are_probed(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 600)]  # copies of a query
    rows += [(600, None), (700, [0.0] * 4), (800, [1.0, None, 0.0, 0.0]), (900, [float("nan")] * 4),
             (901, [float("inf"), 0.0, 0.0, 1.0]), (902, []), (903, [1.0, 2.0]), (None, [1.0] * 4)]
    for blocks in (8192, 16):
        got = {}
        for r in vectors.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, target=1.0, block_rows=blocks,
                                 block_queries=2).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
            assert r.rank == len(got[r.query_id])
        want = plain(rows)
        assert set(got) == set(want) == {0, 100, 200, 300, 400, 500}
        for q in want:
            assert [v for _, v in got[q]] == [v for _, v in want[q]]
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_few_rows_and_none(spark):
    assert vectors.nearest(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert vectors.nearest(frame(spark, [(0, [1.0] * 4)]), F.col("vec_id") % 100 == 0).count() == 0
    unit = [[float(i == j) for i in range(4)] for j in range(2)]
    three = [(0, unit[0]), (1, unit[1]), (2, unit[0]), (2, unit[0])]
    got = vectors.nearest(frame(spark, three), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 2), (2, 2), (3, 1)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float64)
    ids = np.array([r.vec_id for r in table.select("vec_id").orderBy("vec_id").collect()])
    got = {}
    for r in vectors.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = np.lexsort((ids, far))[:10]
        hits += len(set(ids[best]) & set(got[q]))
        total += len(best)
        for v, s in got[q].items():
            assert np.isclose(s, far[ids == v][0], rtol=1e-12)
    assert hits / total >= 0.95


def test_queries_whose_id_or_list_is_crowded(spark):
    """An id on 15 near-equal rows, and lists that hold fewer rows than are asked for."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4) + 40 * (i % 37))]) for i in range(0, 2000, 5)]
    rows += [(100, [float(np.float32(x + 1e-3 * j)) for x in rows[20][1]]) for j in range(15)]
    got = {}
    for r in vectors.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, target=0.5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 2000, 50)) and all(len(v) == 10 and q not in v for q, v in got.items())
