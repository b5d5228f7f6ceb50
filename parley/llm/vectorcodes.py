"""Short codes for vectors: every part of a vector is the number of its nearest codebook entry.

Components become integers and are stored once, in blocks of rows with a dictionary for each dimension: the distinct
integers of the block and, for every row, which of them it has.  A round tabulates the squared differences of every
distinct integer to all codebook entries; the distances of a part are then gathered from these tables by dictionary
code and added up.  The sums for the next codebooks come from counts of (entry, dictionary code).  All arithmetic is on
integers, so the result does not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.common import small_batches, stored
from parley.lookup import lookup_join

BLOCK = 8192  # rows of a block
LIMB = 30  # bits of the digits that very large sums are sent in
WIDE = np.dtype(object)
NARROW = np.dtype(np.int64)


def whole(values: np.ndarray, scale: int, kind: np.dtype) -> np.ndarray:
    """floor(scale * x) of doubles; ``scale`` is a power of two."""
    if kind == NARROW:
        return np.floor(values * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _raw(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes() if values.dtype == NARROW else ",".join(map(str, values)).encode()


def _values(raw: bytes, kind: np.dtype) -> np.ndarray:
    if kind == NARROW:
        return np.frombuffer(raw, "<i8")
    return np.array([int(x) for x in raw.decode().split(",")], object)


class Block:
    """The dictionaries of a block of rows and the rows in their codes."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray, kind: np.dtype):
        self.values, self.codes, self.kind = values, codes, kind

    @classmethod
    def of(cls, numbers: np.ndarray) -> Block:
        """From a row of integers for each vector."""
        found = [np.unique(column, return_inverse=True) for column in numbers.T]
        codes = np.stack([c for _, c in found]).astype("<u2") if found else np.zeros((0, len(numbers)), "<u2")
        return cls([v for v, _ in found], codes, numbers.dtype)

    def columns(self) -> tuple[list[bytes], bytes]:
        return [_raw(v) for v in self.values], self.codes.tobytes()

    @classmethod
    def read(cls, values: list[bytes], codes: bytes, rows: int, kind: np.dtype) -> Block:
        return cls([_values(v, kind) for v in values], np.frombuffer(codes, "<u2").reshape(len(values), rows), kind)

    def assign(self, part: slice, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every row the nearest entry of one part (ties: the first) and the squared distance to it."""
        far = np.zeros((self.codes.shape[1], len(entries)), self.kind)
        for d, own in zip(range(part.start, part.stop), entries.T):
            table = (self.values[d][:, None] - own) ** 2
            far += table[self.codes[d]]
        best = np.argmin(far, 1)
        return best, far[np.arange(len(far)), best]

    def sums(self, part: slice, best: np.ndarray, entries: int) -> np.ndarray:
        """Of each entry's rows the sum in every dimension of the part."""
        out = np.zeros((entries, part.stop - part.start), self.kind)
        for j, d in enumerate(range(part.start, part.stop)):
            size = len(self.values[d])
            times = np.bincount(best * size + self.codes[d], minlength=entries * size).reshape(entries, size)
            out[:, j] = times.astype(self.kind) @ self.values[d]
        return out


def _limbs(value: int, count: int) -> list[int]:
    """Signed digits; a narrow sum is its only digit."""
    if count == 1:
        return [int(value)]
    sign, value = (-1, -int(value)) if value < 0 else (1, int(value))
    return [sign * ((value >> (LIMB * k)) & ((1 << LIMB) - 1)) for k in range(count)]


def parts_of(dimension: int, parts: int) -> list[slice]:
    """Equal consecutive parts; where the dimension is no multiple, the first ones are one longer."""
    ends = np.cumsum([dimension // parts + (k < dimension % parts) for k in range(parts)])
    return [slice(int(a), int(b)) for a, b in zip(np.r_[0, ends[:-1]], ends)]


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in books for entry in book for x in entry)


def encode(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8,
           entries: int = 16, rounds: int = 6, scale: int = 4096, block_rows: int = BLOCK,
           with_codebooks: bool = False) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), and the codebooks as text if wanted, of every kept row.

    Rows whose vector is null or holds null or non-finite components are dropped, as are those of another dimension than
    most have.  The first codebooks are the parts of the rows with the smallest keys (null last; equal keys by vector), so
    fewer rows make smaller codebooks.  Repeated rows stay.  Equal labels share a label_error, nulls among themselves.  An
    empty table gives no rows.  Errors beyond a long are null; components of any size are computed exactly.  Other columns
    are not looked at.  Through the driver go the codebooks and their sums, whose size depends on the parameters alone.
    """
    spark = table.sparkSession
    small_batches(spark, 4096)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(key).alias("key"), F.col(label).alias("label"),
        F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(
        F.count("*").alias("rows"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("top")).orderBy(
            F.desc("rows"), F.desc("n")).first()
    kind, label_kind = (rows.schema[c].dataType for c in ("key", "label"))
    schema = (f"`{key}` {kind.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
              + (", codebooks string" if with_codebooks else ""))
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == sizes.n)
    top = int((sizes.top or 0.0)) * scale + scale
    narrow = sizes.n * (2 * top) ** 2 < 1 << 62 and sizes["rows"] * top < 1 << 62
    number = NARROW if narrow else WIDE
    limbs = 1 if narrow else (sizes["rows"] * top).bit_length() // LIMB + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            whole_block = pa.Table.from_batches(held).combine_chunks()
            flat = whole_block.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            numbers = whole(flat.reshape(len(whole_block), -1), scale, number)
            values, codes = Block.of(numbers).columns()
            return pa.RecordBatch.from_arrays(
                [pa.array([whole_block.column("key").to_pylist()], pa.list_(to_arrow_type(kind))),
                 pa.array([whole_block.column("label").to_pylist()], pa.list_(to_arrow_type(label_kind))),
                 pa.array([values], pa.list_(pa.binary())), pa.array([codes], pa.binary())],
                ["keys", "labels", "values", "codes"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) + 4096 > block_rows:
                if held:
                    yield made()
                held = []
        if held:
            yield made()

    dealt = stored(rows.mapInArrow(blocks, f"keys array<{kind.simpleString()}>, labels array<{label_kind.simpleString()}>, "
                                           "values array<binary>, codes binary"), "blocks")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole(np.array([r.vector for r in first], np.float64).reshape(len(first), -1), scale, number)
    cut = parts_of(sizes.n, parts)
    books = [start[:, p] for p in cut]
    small_batches(spark, 8)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
        for k in range(batch.num_rows):
            yield k, Block.read(batch.column("values")[k].as_py(), batch.column("codes")[k].as_py(),
                                len(batch.column("keys")[k]), number)

    widest = max((p.stop - p.start for p in cut), default=0)
    names = [f"s{j}_{k}" for j in range(widest) for k in range(limbs)]
    for _ in range(rounds):
        now = books

        def summed(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            count = [np.zeros(len(b), np.int64) for b in now]
            total = [np.zeros(b.shape, number) for b in now]
            for batch in batches:
                for _, block in read(batch):
                    for p, part in enumerate(cut):
                        best, _ = block.assign(part, now[p])
                        count[p] += np.bincount(best, minlength=len(now[p]))
                        total[p] += block.sums(part, best, len(now[p]))
            out = []
            for p in range(len(cut)):
                for e in np.flatnonzero(count[p]).tolist():
                    digits = [x for s in total[p][e] for x in _limbs(s, limbs)]
                    out.append([p, e, int(count[p][e]), *digits, *[0] * (len(names) - len(digits))])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * (3 + len(names)))],
                                             ["part", "entry", "n", *names])

        sums = dealt.select("keys", "values", "codes").mapInArrow(
            summed, "part long, entry long, n long" + "".join(f", {c} long" for c in names)).groupBy("part", "entry").agg(
                F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
        books = [b.copy() for b in now]
        for r in sums:
            for j in range(books[r.part].shape[1]):
                total = sum(r[f"s{j}_{k}"] << (LIMB * k) for k in range(limbs))
                books[r.part][r.entry, j] = total // r.n
        if all(np.array_equal(a, b) for a, b in zip(books, now)):
            break  # further rounds would change nothing

    last = books

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in read(batch):
                n = block.codes.shape[1]
                found = [block.assign(part, last[p]) for p, part in enumerate(cut)]
                best = np.stack([b for b, _ in found], 1) if found else np.zeros((n, 0), np.int64)
                error = sum((d for _, d in found), np.zeros(n, number))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[k].values, batch.column("labels")[k].values,
                     pa.array([bytes(row).hex() for row in best.astype(np.uint8)], pa.string()),
                     pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())],
                    ["key", "label", "code", "error"])

    found = stored(dealt.mapInArrow(
        coded, f"key {kind.simpleString()}, label {label_kind.simpleString()}, code string, error long"), "codes")
    # a null label is the null group, whatever value stands in for it
    keyed = found.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    per_label = keyed.groupBy("_none", "_label").agg(
        F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    text = codebook_text(books)
    out = lookup_join(keyed, per_label, ["_none", "_label"], salt_by=[F.col("key"), F.col("code")])
    return out.select(F.col("key").alias(key), "code", "error", "label_error",
                      F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"),
                      *([F.lit(text).alias("codebooks")] if with_codebooks else []))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, where the dimension is a multiple of the parts and integers fit."""
    far = "list_sum(list_transform(list_zip(q.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn, len(embedding) // {parts} AS w,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""piece AS MATERIALIZED (
  SELECT rn, p, v[p * w + 1:p * w + w] AS s FROM kept, range({parts}) t(p))""",
             f"b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, s FROM piece WHERE rn <= {entries})"]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT q.rn, q.p, any_value(q.s) AS s, min(struct_pack(d := {far}, e := b.e)) AS best
  FROM piece q JOIN b{k} b ON q.p = b.p GROUP BY q.rn, q.p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM b{k} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY j) AS s FROM (
      SELECT p, best.e AS e, j, CAST(floor(CAST(sum(s[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x
      FROM (SELECT p, best, s, unnest(range(1, len(s) + 1)) AS j FROM a{k}) GROUP BY p, best.e, j) GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept k JOIN (
  SELECT rn, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rn) c ON k.rn = c.rn"""
