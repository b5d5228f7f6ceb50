"""Incremental operation under Structured Streaming.

The stream checkpoint is the cursor.  Delivery is at least once; every sink merges by key and never lets an older change
replace a newer one, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parley.operators.filters import (
    INDEX_VERSION, conversation_docs, last_sync, message_docs, outdated_count, split_changes)
from parley.operators.merge import adjust_votes, newest
from parley.session import cut_lineage
from parley.sources.index import Index, Shape, read_if_there, write_batch

SYNC_SECONDS, CHAT_SYNC_SECONDS, COMMIT_SECONDS, MIN_COMMIT_SECONDS = 15, 30, 10, 1
EPOCH_FILES = 1000
BatchFunction = Callable[[DataFrame, int], None]


def changes(spark: SparkSession, path: str, schema: StructType, max_files: int = EPOCH_FILES,
            file_name: str | None = None) -> DataFrame:
    """Stream of change rows from Parquet files, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    return reader.parquet(path)


def run(stream: DataFrame, each: BatchFunction, checkpoint: str, period_s: int | None = None) -> StreamingQuery:
    """Start a sync: every ``period_s`` seconds, or once over all that is available."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if period_s is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{max(period_s, MIN_COMMIT_SECONDS)} seconds").start()


def latest_state(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key of a batch."""
    return newest(batch, keys, order)


def newer_than_stored(batch: DataFrame, index: Index, key: str, order: str) -> DataFrame:
    """Rows of the batch that are not older than what is stored for their key; only the buckets of its keys are read."""
    if not index.batches:
        return batch
    known = index.changes(batch.select(key)).groupBy(key).agg(F.max(order).alias("_stored"))
    joined = batch.join(known, key, "left")
    return joined.filter(F.col("_stored").isNull() | (F.col(order) >= F.col("_stored"))).drop("_stored")


def index_sink(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], key: str = "conv_id",
               modified: str = "last_modified", shape: Shape | None = None) -> BatchFunction:
    """Batch function that keeps the index at ``path`` current: its documents, and with a ``shape`` that names a text its
    postings and frequencies too.

    A batch is reduced to the newest row per key.  Removals (``deleted`` set) stay as tombstones, so that an older change
    arriving late cannot bring a removed entry back; a tombstone keeps the columns of the change that documents have too,
    but no text.
    """
    shape = shape or Shape(key, text=None)

    def each(batch: DataFrame, _: int) -> None:
        state = cut_lineage(newer_than_stored(latest_state(batch, [key], modified), Index(spark, path, shape), key, modified))
        updates, removals = split_changes(state)
        docs = build(updates).withColumn("tombstone", F.lit(False))
        kept = [c for c in removals.columns if c in docs.columns and c != shape.text]
        stamped = docs.unionByName(removals.select(*kept).withColumn("tombstone", F.lit(True)),
                                   allowMissingColumns=True).withColumn("sync_date", F.col(modified))
        # a changed conversation without documents takes its old ones away
        write_batch(stamped, path, shape, state.select(key))

    return each


def live_docs(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("tombstone")).drop("tombstone")


def rebuild_docs(conv: DataFrame, msg: DataFrame, path: str, shape: Shape = Shape(text=None)) -> None:
    """Write the whole index again, in place of all that is there: conversation documents and message documents."""
    live = conv.filter(F.col("deleted").isNull())
    whole = conversation_docs(live, msg).select("conv_id", F.lit(-1).alias("idx"), "type", "version", "owner",
                                                "completed", F.array_join("messages", "\n").alias("content"))
    single = message_docs(live, msg).select("conv_id", "idx", "type", "version", "owner", "completed",
                                            "content")
    docs = whole.unionByName(single).withColumn("sync_date", F.lit(None).cast("timestamp"))
    write_batch(docs, path, shape, whole=True)


def needs_rebuild(docs: DataFrame | None, version: int = INDEX_VERSION) -> bool:
    """True without documents or with documents of another version; else the sync resumes from the last one."""
    if docs is None:
        return True
    counts = outdated_count(docs, version).first()
    return counts["docs"] == 0 or counts["outdated"] > 0


def resume_from(docs: DataFrame) -> DataFrame:
    return last_sync(docs)


def on_change(events: DataFrame) -> DataFrame:
    """Store events that act at once: saves of complete conversations, and deletions."""
    saved = (F.col("operation") == "SAVE") & (F.col("status") == "Complete")
    removed = F.col("operation") == "DELETE"
    return events.filter(saved | removed).withColumn("action", F.when(removed, "remove").otherwise("index"))


def rating_sink(path: str) -> BatchFunction:
    """Batch function that keeps the vote changes (conv_id, msg_id, delta) of every batch, summed, below ``path``.

    A batch has a folder of its own and a repeated batch writes it again, so nothing is counted twice, and no state is
    held: ``rated_messages`` applies what has been written.
    """

    def each(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("conv_id", "msg_id").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def rated_messages(spark: SparkSession, msg: DataFrame, path: str) -> DataFrame:
    """``msg`` with the votes of all batches of a ``rating_sink`` added."""
    deltas = read_if_there(spark, path)
    return msg if deltas is None else adjust_votes(msg, deltas)


def analysis_sink(spark: SparkSession, path: str, analyse: Callable[[DataFrame], DataFrame], key: str = "conv_id"
                  ) -> BatchFunction:
    """Re-analyse the conversations changed in a batch, each once, and store the result (columns ``key``, ``date``)
    unless a newer analysis is stored already."""
    shape = Shape(key, text=None)

    def each(batch: DataFrame, _: int) -> None:
        keys = batch.groupBy(key).agg(F.max("date").alias("date"))
        fresh = newer_than_stored(keys, Index(spark, path, shape), key, "date")
        write_batch(analyse(cut_lineage(fresh)), path, shape)

    return each
