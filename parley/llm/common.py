"""What the operators share: tables, shared storage, word splitting, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the one that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/parley-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written to the shared folder: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def files_at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, blocks: list) -> None:
    """Write buffers one after the other; the name must be new for each attempt of a task."""
    system, path = files_at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        for block in blocks:
            out.write(block)


def map_file(uri: str) -> pa.Buffer:
    """The file's bytes, memory-mapped where the shared folder is a mounted one."""
    system, path = files_at(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with system.open_input_file(path) as source:
        return source.read_buffer()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows and bytes that a Python worker holds at once: rows here may be long texts.

    Workers on this machine also get the place of this package; a cluster has it installed or in its --py-files.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One array of all UTF-8 bytes and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]] if len(ends) else whole, ends - ends[0]


def pieces(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts have at most ``size`` bytes together, or of one longer text: arrays over
    all bytes of a slice take tens of times its size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def partition_table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition whose size its writer has bounded."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that passes its rows' columns on: columns that begin with an underscore, as the operators' own do, bear
    other names while it runs."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        cover = "shielded"
        while any(c.startswith(cover) for c in docs.columns):
            cover += "_"
        names = {c: f"{cover}{k}" for k, c in enumerate(docs.columns) if c.startswith("_")}
        return operator(docs.withColumnsRenamed(names), *args, **options).withColumnsRenamed({v: c for c, v in names.items()})

    return run


ROW = "_row"


def with_row(docs: DataFrame) -> DataFrame:
    """Adds ``_row``: the key and a hash of the whole row, which only rows that are the same in all columns share."""
    return docs.withColumn(ROW, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(*docs.columns).alias("print")))


def only(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` (see ``with_row``) that ``rows`` names, in all their columns; repeated rows ``once`` or all."""
    chosen = rows.select(F.col(f"{ROW}.doc_id").alias("_id"), F.col(f"{ROW}.print").alias("_print")).distinct()
    own = docs.dropDuplicates([ROW]) if once else docs
    same = F.col(f"{ROW}.doc_id").eqNullSafe(F.col("_id")) & (F.col(f"{ROW}.print") == F.col("_print"))
    return own.join(chosen, same, "left_semi").drop(ROW)
