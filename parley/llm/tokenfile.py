"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A dataset is a folder of shards in key order and the rank table.  In a shard every frame holds the ids of some
documents: control bytes first (two bits an id, four ids a byte: how many bytes the id's rank takes), then the bytes
of all ranks.  Frequent ids have small ranks and take one byte.  An index after the frames names the documents:

    frame, frame, ..., index (JSON), length of the index (8 bytes), MAGIC
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm.common import map_file, new_folder, ranges, small_batches, stored, text_bytes, write_file
from parley.llm.wordbpe import load

MAGIC = b"RANKVB01"
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    codes[:len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The values again: lengths come from a table by control byte, values from four bytes at each place."""
    size = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    at = padded[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            at[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return at


def token_table(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of every whole text and the end id, as little-endian 32-bit numbers in one binary value."""
    small_batches(docs.sparkSession, 2000)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, counts = bpe.encode_column(batch.column(1))
            ends = np.cumsum(counts)
            flat = np.insert(ids, ends, end_id).astype("<u2" if bpe.size <= 1 << 16 else "<u4")
            offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)] * flat.itemsize
            column = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ends), flat.itemsize, np.int32)), column.cast(pa.binary())],
                ["key", "width", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(apply, f"key {kind}, width int, ids binary"))


def _flat_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of a token table, and the number of each row."""
    width = batch.column(batch.schema.get_field_index("width"))[0].as_py()
    raw = text_bytes(batch.column(batch.schema.get_field_index("ids")))
    counts = np.array([len(b) // width for b in raw], np.int64)
    return np.frombuffer(b"".join(raw), f"<u{width}").astype(np.int64), counts


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; every task adds up its own rows first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.bincount(_flat_ids(batch)[0])
                if len(own) > len(total):
                    own, total = total, own
                total[:len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("width", "ids").mapInArrow(apply, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, ids_per_file: int = 4 << 20,
                      key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode ``docs`` and write them below ``folder`` in ascending key order (nulls first); returns the shards.

    The rank table has one entry for each id of the vocabulary that occurs, so it may go through the driver.  Each
    attempt of a task writes a file of its own name, and only the files of the attempts that Spark accepted are
    listed: a lost executor leaves at most an unlisted file.  Rows with equal keys keep an order given by their ids.
    The list has one entry a file (name, first id, number of ids and documents).
    """
    spark = docs.sparkSession
    tokens = stored(token_table(docs, path, end_id, key, text), "tokens")
    counts = sorted(((r.n, -r.id) for r in id_counts(tokens).collect()), reverse=True)
    by_rank = np.array([-i for _, i in counts], np.int64)
    total = sum(n for n, _ in counts)
    write_file(f"{folder}/ranks.bin", [by_rank.astype("<u4").tobytes()])
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        frames, blocks, place = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _flat_ids(batch)
            control, data = pack(rank_of[ids])
            frames.append({"at": place, "control": len(control), "data": len(data), "ids": len(ids),
                           "counts": counts.tolist(), "keys": batch.column(0).to_pylist()})
            blocks += [control, data]
            place += len(control) + len(data)
        if not frames:
            return
        index = json.dumps(frames).encode()
        write_file(f"{folder}/{name}", [*blocks, index, len(index).to_bytes(8, "little"), MAGIC])
        yield pa.RecordBatch.from_arrays(
            [pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([sum(f["ids"] for f in frames)]),
             pa.array([sum(len(f["counts"]) for f in frames)])], ["part", "name", "ids", "docs"])

    files = max(1, -(-total // ids_per_file))
    tie = F.xxhash64("ids")
    dealt = tokens.repartitionByRange(files, F.col("key").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("key").asc_nulls_first(), tie)
    shards = stored(dealt.mapInArrow(apply, "part int, name string, ids long, docs long"), "shards")
    out, first = [], 0
    for row in shards.orderBy("part").collect():
        out.append({"name": row.name, "first": first, "ids": row.ids, "docs": row.docs})
        first += row.ids
    write_file(f"{folder}/dataset.json", [json.dumps({"key": docs.schema[key].dataType.simpleString(),
                                                      "shards": out}).encode()])
    return out


@lru_cache(maxsize=2)
def _ranks(folder: str) -> np.ndarray:
    return np.frombuffer(map_file(f"{folder}/ranks.bin"), "<u4")


def read_shard(folder: str, name: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of each frame: keys, number of ids of each document, all ids."""
    whole = np.frombuffer(map_file(f"{folder}/{name}"), np.uint8)
    if whole[-8:].tobytes() != MAGIC:
        raise ValueError(f"{name} is no token file")
    size = int.from_bytes(whole[-16:-8].tobytes(), "little")
    ranks = _ranks(folder)
    for frame in json.loads(whole[-16 - size:-16].tobytes()):
        at, split = frame["at"], frame["at"] + frame["control"]
        values = unpack(whole[at:split], whole[split:split + frame["data"]], frame["ids"])
        yield frame["keys"], np.array(frame["counts"], np.int64), ranks[values]


def read_token_files(spark: SparkSession, folder: str, shards: list[dict], kind: str = "bigint",
                     key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files; one task reads one or more whole files."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keys, counts, ids in read_shard(folder, name):
                    ends = np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, type_of), pa.array(first + ends - counts), pa.array(counts),
                        pa.array([zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, counts)], pa.int64())],
                        ["key", "start", "n_tokens", "ids_crc32"])
                    first += int(counts.sum())

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    type_of = to_arrow_type(_parse_datatype_string(kind))
    names = spark.createDataFrame([(s["name"], s["first"]) for s in shards], "name string, first long")
    return (names.repartition(max(1, len(shards))).mapInArrow(
        apply, f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key))


def written_and_read(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back, see the two functions above.

    Null and empty texts hold the end id alone.  Rows without a key come first.  Repeated rows stay.  An empty table
    gives no rows.  Only key and text are read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    shards = write_token_files(docs, path, folder, end_id, key=key, text=text)
    return read_token_files(spark, folder, shards, docs.schema[key].dataType.simpleString(), key)
