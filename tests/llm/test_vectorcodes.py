import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parley.llm import vectorcodes


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in Python integers: rows of (key, vector, label)."""
    kept = [(k, [math.floor(Fraction(x) * 4096) for x in v], lab) for k, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(s, book):
        return min((sum((x - y) ** 2 for x, y in zip(s, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(nearest(cut(r[1], p), books[p])[1], []).append(cut(r[1], p))
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else old
                        for e, old in enumerate(books[p])]
    text = ",".join(str(x) for b in books for e in b for x in e)
    out = []
    for k, v, lab in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), lab))
    per = {}
    for _, _, e, lab in out:
        per[lab] = per.get(lab, 0) + e
    return [(k, c, e, per[lab], hashlib.sha256(text.encode()).hexdigest()) for k, c, e, lab in out]


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, 0) for k, v, lab in rows], "vec_id long, embedding array<double>, label int, error int")


def made(n, scale=1.0, dimension=16):
    return [(i * 3 % 1000, [scale * math.sin(i * 1.7 + j * j) for j in range(dimension)], [None, 1, 2, 2][i % 4]) for i in range(n)]


ODD = [(5, None, 1), (6, [None] * 16, 1), (7, [float("nan")] * 16, 2), (8, [float("inf")] + [0.0] * 15, 2), (9, [0.0] * 16, 3),
       (9, [0.0] * 16, 3), (None, [0.25] * 16, None), (9, [-0.5] * 16, None)]


@pytest.mark.parametrize("rows", [made(300) + ODD, made(7), [(1, [0.5] * 16, None)] * 40, made(90, 1e30), made(40, 1e300) + ODD,
                                  made(60, 3e5)], ids=["odd", "few", "equal", "wide", "widest", "between"])
def test_like_the_plain_version(spark, rows):
    want = sorted(plain(rows), key=str)
    got = [tuple(r) for r in vectorcodes.encode(frame(spark, rows).repartition(5), block_rows=64).collect()]
    beyond = lambda x: x if x < 1 << 63 else None
    assert sorted(got, key=str) == sorted([(k, c, beyond(e), beyond(s) if beyond(e) is not None else None, h)
                                           for k, c, e, s, h in want], key=str)


def test_dimension_that_is_no_multiple_and_other_dimensions(spark):
    rows = [(i, [i / 7, i / 3, 0.5], 1) for i in range(30)] + [(99, [1.0] * 4, 1), (98, [], 2)]
    got = vectorcodes.encode(frame(spark, rows), parts=2).collect()
    assert sorted(r.vec_id for r in got) == list(range(30)) and {len(r.code) for r in got} == {4}
    assert vectorcodes.parts_of(7, 3) == [slice(0, 3), slice(3, 5), slice(5, 7)]


def test_codebooks_and_empty_tables(spark):
    got = vectorcodes.encode(frame(spark, made(50)), with_codebooks=True).first()
    assert hashlib.sha256(got.codebooks.encode()).hexdigest() == got.codebooks_sha256
    for rows in ([], [(1, None, 1)], [(1, [None], 1)]):
        assert vectorcodes.encode(frame(spark, rows)).count() == 0
    none = frame(spark, made(20)).withColumn("embedding", F.array().cast("array<double>"))
    assert {r.error for r in vectorcodes.encode(none).collect()} == {0}
