"""Writers: exports, imported conversations and stored corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.operators.filters import not_deleted
from parley.scan import bucket_of, spread_join
from parley.session import cut_lineage
from parley.sources.index import BUCKETS, Index, Shape, read_if_there, write_batch

# The columns of the flat export.
FLAT_COLUMNS = ["ID", "Status", "User", "Channel", "Domain", "Date", "Msg Idx", "Msg Id", "Sender", "Sent", "Content"]


def nested_conversations(conv: DataFrame, msg: DataFrame) -> DataFrame:
    """Conversations as single objects with all their messages."""
    message = F.struct(
        "idx", F.struct(
            F.col("msg_id").alias("id"), "time", "origin", "content", F.when(F.col("user_id").isNotNull(), F.struct(
                F.col("user_id").alias("id"), F.col("user_name").alias("displayName"))).alias("user"),
            "private", "votes", "metadata").alias("m"))
    lists = msg.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(message)), lambda e: e["m"]).alias("messages"))
    return conv.join(lists, "conv_id", "left").select(
        F.col("conv_id").cast("string").alias("id"), "owner", F.struct("status", "properties").alias("meta"), "user",
        "context", F.col("last_modified").alias("lastModified"), "deleted", F.coalesce(
            "messages", F.expr("filter(array(null), x -> false)")).alias("messages"))


def export_conversations(conv: DataFrame, msg: DataFrame, owner: str, path: str) -> None:
    """All live conversations of an owner, one JSON object per line."""
    live = not_deleted(conv).filter(F.col("owner") == owner)
    # metadata and times keep their type; array_sort needs comparable entries, so the map travels as JSON text
    kept = msg.join(live.select("conv_id"), "conv_id", "left_semi").withColumn("metadata", F.to_json("metadata"))
    nested_conversations(live, kept).withColumn("messages", F.transform("messages", lambda m: m.withField(
        "metadata", F.from_json(m["metadata"], "map<string,string>")))).write.mode("overwrite").json(path)


def store_imported(conv: DataFrame, msg: DataFrame, path: str, replace: bool = False) -> None:
    """Store imported conversations below ``path``, one partition per owner.

    A conversation takes the place of the stored one with its id, messages included; ``replace`` drops all else that
    the owners given have stored.  What is kept is checkpointed before any partition is written again.
    """
    spark = conv.sparkSession
    owned = spread_join(msg.withColumn("_bucket", bucket_of("idx")), conv.select("conv_id", "owner"), ["conv_id"],
                        "_bucket").drop("_bucket")
    ids, owners = conv.select("conv_id"), conv.select("owner").distinct()
    before = read_if_there(spark, f"{path}/conversations")
    if before is not None:  # an id may have moved from another owner, whose partition is then written again too
        owners = owners.unionByName(before.join(ids, "conv_id", "left_semi").select("owner")).distinct()
    touched = cut_lineage(owners)
    for name, df in (("conversations", conv), ("messages", owned)):
        stored = read_if_there(spark, f"{path}/{name}")
        if stored is not None and not replace:
            kept = stored.join(touched, "owner", "left_semi").join(ids, "conv_id", "left_anti")
            df = kept.select(*df.columns).unionByName(df)
        elif stored is not None:
            given = conv.select("owner").distinct()
            kept = stored.join(touched, "owner", "left_semi").join(ids, "conv_id", "left_anti").join(
                given, "owner", "left_anti")
            df = kept.select(*df.columns).unionByName(df)
        df = cut_lineage(df)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner").parquet(
            f"{path}/{name}")
        if stored is not None:  # owners that have lost all they had, as a rule none
            emptied = touched.join(df.select("owner").distinct(), "owner", "left_anti")
            _drop_folders(spark, path + "/" + name, "owner", {r.owner for r in emptied.collect()})


def conversations_to_flat(conv: DataFrame, msg: DataFrame, include_invalid: bool = False, include_open: bool = False
                          ) -> DataFrame:
    """One row per message with the conversation's columns; conversations without a printable message give one row.

    Only complete conversations unless ``include_open``; only messages with id, time, content and user unless
    ``include_invalid``.  The date of a conversation is the time of the first message, in list order, that has one.
    """
    chosen = conv if include_open else conv.filter(F.col("status") == "Complete")
    head = chosen.select(
        F.col("conv_id"), F.col("status").alias("Status"), F.col("user.id").alias("User"),
        F.get(F.try_element_at("properties", F.lit("channel_id")), F.lit(0)).alias("Channel"),
        F.col("context.domain").alias("Domain"))
    dates = msg.filter(F.col("time").isNotNull()).groupBy("conv_id").agg(F.min_by("time", "idx").alias("Date"))
    head = head.join(dates, "conv_id", "left")
    complete = (F.col("msg_id").isNotNull() & F.col("time").isNotNull() & F.col("content").isNotNull()
                & F.col("user_id").isNotNull())
    printed = msg if include_invalid else msg.filter(complete)
    rows = printed.select("conv_id", F.col("idx").alias("Msg Idx"), F.col("msg_id").alias("Msg Id"),
                          F.col("user_id").alias("Sender"), F.col("time").alias("Sent"), F.col("content").alias("Content"))
    printable = spread_join(rows.withColumn("_bucket", bucket_of("Msg Idx")), head, ["conv_id"], "_bucket")
    empty = head.join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
    return printable.drop("_bucket").unionByName(empty, allowMissingColumns=True).withColumnRenamed(
        "conv_id", "ID").select(*FLAT_COLUMNS)


def write_flat(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def write_corpus(docs: DataFrame, path: str, keys: list[str], text: str, scope: tuple[str, ...] = (),
                 buckets: int = BUCKETS) -> Shape:
    """Store a corpus as an index (postings, document frequencies, word pieces, sizes) in place of what is there, so that
    queries need not read its texts again; returns its shape."""
    shape = Shape(keys[0], tuple(keys), tuple(scope), text, buckets)
    write_batch(docs.select(*dict.fromkeys([*keys, *scope, text])), path, shape, whole=True)
    return shape


def read_corpus(spark: SparkSession, path: str, shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, document frequencies and sizes of a stored corpus."""
    index = Index(spark, path, shape)
    return index.postings(), index.frequencies(), index.sizes()


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _drop_folders(spark: SparkSession, path: str, column: str, values: set) -> None:
    """Partitions left without a row are not touched by a dynamic overwrite."""
    for value in values:
        system, place = _folder(spark, f"{path}/{column}={value}")
        system.delete(place, True)
