"""Readers: files in the exchanged formats as model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.schema import CHAT_EVENT, CONVERSATION_JSON


def parse_conversations(raw: DataFrame, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversation objects (``CONVERSATION_JSON``) as the conversation and the message table."""
    no_map = F.expr("cast(map() as map<string,array<string>>)")
    channel = F.when(F.col("meta.channel_id").isNotNull(), F.create_map(F.lit("channel_id"), "meta.channel_id"))
    given = F.coalesce("meta.properties", no_map)
    properties = F.map_concat(F.map_filter(F.coalesce(channel, no_map), lambda k, v: ~F.map_contains_key(given, k)),
                              given)
    conv = raw.select(
        F.col("id").alias("conv_id"), (F.lit(owner) if owner is not None else F.col("owner")).alias("owner"), "user",
        F.col("meta.status").alias("status"), F.map_filter(
            properties, lambda k, v: v.isNotNull() & (F.size(v) > 0)).alias("properties"),
        "context", F.col("lastModified").alias("last_modified"), "deleted")
    msg = raw.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("idx", "m")).select(
        "conv_id", "idx", F.col("m.id").alias("msg_id"), "m.time", "m.origin", "m.content",
        F.col("m.user.id").alias("user_id"), F.col("m.user.displayName").alias("user_name"),
        F.coalesce("m.private", F.lit(False)).alias("private"), F.coalesce("m.votes", F.lit(0)).alias("votes"),
        F.coalesce("m.metadata", F.expr("cast(map() as map<string,string>)")).alias("metadata"))
    return conv, msg


def read_conversations(spark: SparkSession, path: str, owner: str | None = None, json_array: bool = True
                       ) -> tuple[DataFrame, DataFrame]:
    """JSON conversations of one owner.

    With ``json_array`` every file is one array, which only one task can read; large imports should come as one object
    per line (``json_array=False``), which is split.
    """
    raw = spark.read.schema(CONVERSATION_JSON).option("multiLine", json_array).json(path)
    return parse_conversations(raw, owner)


def _list_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


def stopword_table(lines: DataFrame, lang: str | None) -> DataFrame:
    """Stop words by lower-case key with the variants as written (column ``line``)."""
    kept = lines.filter((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
    return kept.groupBy(F.lower("line").alias("key")).agg(F.array_sort(F.collect_set("line")).alias("variants")).select(
        F.lit(lang).cast("string").alias("lang"), "key", "variants")


def read_stopwords(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """One stop word per line; blank lines and lines starting with # are comments."""
    return stopword_table(_list_lines(spark, path), lang)


def read_snowball_stopwords(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """The snowball format: a vertical bar starts a comment, a line may hold several words."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim(F.substring_index("value", "|", 1)), r"\s+")).alias(
        "line"))
    return stopword_table(words, lang)


def read_vocabulary(spark: SparkSession, path: str, sep: str = ",", tag: str | None = None, lang: str | None = None
                    ) -> DataFrame:
    """Concept and synonyms per line; the first column is the label, and every column is a surface form."""
    cells = spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(
        F.transform(F.split("value", f"[{sep}]"), lambda c: F.trim(c)).alias("cells"))
    return cells.select(F.get("cells", F.lit(0)).alias("label"), F.explode("cells").alias("surface")).filter(
        F.col("surface") != "").distinct().withColumn("tag", F.lit(tag).cast("string")).withColumn(
        "lang", F.lit(lang).cast("string"))


def chat_messages(events: DataFrame) -> DataFrame:
    """Chat events (``CHAT_EVENT``) as messages; the channel is the conversation."""
    return events.select(
        F.col("channel_id").alias("conv_id"), F.col("message_id").alias("msg_id"),
        F.timestamp_millis("timestamp").alias("time"),
        F.when(F.col("bot.identifier").isNotNull(), "Bot").otherwise(F.coalesce("origin", F.lit("User"))).alias("origin"),
        F.col("text").alias("content"), "user_id", "user_name", "support_area")


def read_chat_events(spark: SparkSession, path: str, max_files: int = 1000, file_name: str | None = None) -> DataFrame:
    """Stream of chat events from JSON lines appearing in a folder."""
    reader = spark.readStream.schema(CHAT_EVENT).option("maxFilesPerTrigger", max_files)
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    return reader.json(path)


def ingest_chat_docs(raw: DataFrame, client: Column) -> tuple[DataFrame, DataFrame]:
    """JSON texts (column ``json``), each one object or a list of objects, as chat documents; others are rejected.

    Numbered by ``seq`` in the order of ``raw.seq`` and the position in the list.
    """
    text = F.trim("json")
    wrapped = F.when(F.startswith(text, F.lit("[")), text).when(
        F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]")))
    items = F.from_json(wrapped, "array<map<string,string>>")
    plain = raw.withColumn("_items", items)
    usable = F.coalesce(F.size("_items") > 0, F.lit(False)) & F.coalesce(
        F.forall("_items", lambda d: F.try_element_at(d, F.lit("id")).isNotNull()), F.lit(False))
    rejected = plain.filter(~usable).drop("_items").withColumn("reason", F.lit("unexpected data format"))
    docs = plain.filter(usable).select("seq", F.posexplode("_items").alias("_n", "data"), client.alias("client"))
    return docs.select("client", F.col("data")["id"].alias("id"), "data", F.struct("seq", "_n").alias("seq")), rejected


def register_corpus(name: str, docs: DataFrame, key: Sequence[str], text: str, chain: str = "standard"
                    ) -> tuple[str, DataFrame, Column]:
    """A corpus that only serves term statistics: its name, document frequencies and size."""
    from parley.operators.search import postings, term_stats

    stats = term_stats(postings(docs, list(key), text, chain))
    return name, stats, docs.agg(F.count(F.lit(1)).alias("n")).scalar()
