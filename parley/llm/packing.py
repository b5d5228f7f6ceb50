"""Harmonic packing of documents into sequences of bounded length.

Lengths fall into reciprocal-capacity classes: class k holds those in (capacity / (k + 1), capacity / k], and a bin of
class k holds exactly k pieces, whatever they are.  So a worker fills bins without knowing of any other, and nothing
is searched.  What a document has beyond whole bins is cut where a class begins, so that pieces nearly fill their
share: a piece wastes at most 1/64 of its place.

Of every class a worker has fewer than k pieces left over.  They go up a tree: the left-overs of 32 workers are filled
into bins by one task, and so on; the last few lie end to end, the rest of them in sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parley.llm.bytebpe import load
from parley.llm.common import small_batches, stored

FAN = 32  # workers whose left-overs one task takes
TAIL = 32  # pieces this short are not cut further
WASTE = 64  # a piece may leave this part of its place empty


@lru_cache(maxsize=1 << 16)
def tails(rest: int, capacity: int) -> tuple[int, ...]:
    """Lengths of the pieces of what is less than a whole bin."""
    out = []
    while rest:
        k = capacity // rest
        if rest <= TAIL or (capacity // k - rest) * WASTE <= capacity // k:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return tuple(out)


def pieces(length: int, capacity: int) -> tuple[int, ...]:
    """Lengths of the pieces that a document of ``length`` ids is cut into."""
    return (capacity,) * (length // capacity) + tails(length % capacity, capacity)


class Bins:
    """Open bins of one worker, at most one a class; full ones and, at the end, left-overs come out as rows."""

    NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "worker", "left"]

    def __init__(self, capacity: int, level: int, worker: int, keep_ids: bool):
        self.capacity, self.worker, self.keep_ids = capacity, worker, keep_ids
        self.next = (level << 58) | (worker << 32)
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, key, start: int, ids: np.ndarray, total: int) -> None:
        k = self.capacity // len(ids)
        if k == 1:
            self.close([(key, start, ids, total)])
            return
        bin_ = self.open.setdefault(k, [])
        bin_.append((key, start, ids, total))
        if len(bin_) == k:
            self.close(bin_)
            del self.open[k]

    def close(self, bin_: list[tuple]) -> None:
        at = 0
        for key, start, ids, total in bin_:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(raw), total, self.next, at,
                              raw if self.keep_ids else None, self.worker, False))
            at += len(ids)
        self.next += 1

    def leave(self) -> None:
        """Left-overs as rows without a sequence, for the next level."""
        for k in sorted(self.open):
            for key, start, ids, total in self.open[k]:
                raw = ids.astype("<u4").tobytes()
                self.rows.append((key, start, len(ids), zlib.crc32(raw), total, None, None, raw, self.worker, True))
        self.open = {}

    def lay(self) -> None:
        """Left-overs end to end: whole sequences, and the rest in sequences of powers of two."""
        line = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) for p in line)
        room, bin_ = 0, []
        for key, start, ids, total in line:
            while len(ids):
                if not room:
                    room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                    rest -= room
                part, ids = ids[:room], ids[room:]
                bin_.append((key, start, part, total))
                start, room = start + len(part), room - len(part)
                if not room:
                    self.close(bin_)
                    bin_ = []

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.binary(), pa.int32(), pa.bool_()]
        columns = zip(*self.rows) if self.rows else [()] * len(kinds)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], self.NAMES)
        self.rows = []
        return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids if they are kept, of every piece.

    Whole texts are encoded and get the end id; every id lies in one piece.  Null and empty texts are the end id
    alone.  Repeated rows and rows without a key are documents like any other.  An empty table gives no rows.  Columns
    besides key and text are not looked at.  Sequence ids are unique, not gapless.
    """
    spark = docs.sparkSession
    small_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_type

    kind, of = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    schema = (f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "ids binary, worker int, left boolean")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = load(path), Bins(capacity, 0, TaskContext.get().partitionId(), keep_ids)
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(bpe.encode(own or ""), np.uint32(end_id))
                at = 0
                for size in pieces(len(ids), capacity):
                    bins.add(name, at, ids[at:at + size], len(ids))
                    at += size
            yield bins.batch(of)
        bins.leave()
        yield bins.batch(of)

    def refill(level: int, last: bool):
        def apply(group: tuple, rows: pa.Table) -> pa.Table:
            bins = Bins(capacity, level, group[0].as_py(), keep_ids)
            rows = rows.sort_by([("worker", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            for row in rows.select(["key", "start", "ids", "doc_tokens"]).to_pylist():
                bins.add(row["key"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
            bins.lay() if last else bins.leave()
            return pa.Table.from_batches([bins.batch(of)])

        return apply

    tier = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(fill, schema), "pieces")
    done = tier.filter(~F.col("left"))
    left = tier.filter("left")
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    level = 0
    while True:  # as often as the number of workers can be divided by FAN
        level, workers = level + 1, -(-workers // FAN)
        tier = stored(left.withColumn("group", F.expr(f"cast(worker div {FAN} as int)")).groupBy("group").applyInArrow(
            refill(level, workers == 1), schema), "pieces")
        done, left = done.unionByName(tier.filter(~F.col("left"))), tier.filter("left")
        if workers == 1:
            break
    return done.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, used, ids, lengths): the padded ids of every sequence and the lengths of its pieces.

    ``packed`` are pieces with their ids.  A sequence is padded to the capacity unless it is a power of two long.
    """

    def apply(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4")
        used = len(ids)
        whole = ids if used & (used - 1) == 0 else np.append(ids, np.full(capacity - used, pad_id, "<u4"))
        return pa.table({"sequence_id": group[0].as_py() + np.zeros(1, np.int64), "used": [used],
                         "ids": pa.array([whole.astype(np.int32)], pa.list_(pa.int32())),
                         "lengths": pa.array([rows.column("length").to_pylist()], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInArrow(
        apply, "sequence_id long, used long, ids array<int>, lengths array<long>")
