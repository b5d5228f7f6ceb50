"""The driver's tables as model tables.

The driver tables have neither chat times nor owners; those are arithmetic on the keys so that the SQL twin of every
query can repeat them.  The ``*_SQL`` strings are the same derivations as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.scan import ordinal
from parley.session import cut_lineage

EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share the rows of a scan with fewer partitions than cores among all cores.

    Large tables have more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def _every(expression: str) -> Column:
    return F.expr(f"({expression}) = 0")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from the ``conversations`` table."""
    return spread(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(
        "conv_id",
        F.col("turn").cast("int").alias("idx"),
        F.when(_every("(conv_id + turn) % 11"), "").otherwise(F.concat_ws("-", F.lit("m"), "conv_id", "turn"))
        .alias("msg_id"),
        F.timestamp_seconds(F.expr(f"{EPOCH} + conv_id * 3600 + turn * (10 + (conv_id * 7 + turn * 13) % 50)"))
        .alias("time"),
        F.when(F.col("role") == "user", "User").otherwise("Agent").alias("origin"),
        F.col("text").alias("content"),
        F.expr("case when role = 'system' then null else concat(role, conv_id % 7) end").alias("user_id"),
        F.expr("case when role = 'system' then null else upper(role) end").alias("user_name"),
        _every("(conv_id * 3 + turn * 5) % 17").alias("private"),
        F.expr("cast((conv_id * 5 + turn * 7) % 4 as int)").alias("votes"),
        F.when(_every("(conv_id + turn * 3) % 13"), F.create_map(F.lit("skipAnalysis"), F.lit("true")))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("metadata"),
    )


MSG_SQL = f"""msg AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS idx,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE concat('m-', conv_id, '-', turn) END AS msg_id,
    1000 * ({EPOCH} + conv_id * 3600 + turn * (10 + (conv_id * 7 + turn * 13) % 50)) AS t,
    CASE WHEN role = 'user' THEN 'User' ELSE 'Agent' END AS origin, text AS content,
    CASE WHEN role = 'system' THEN NULL ELSE concat(role, conv_id % 7) END AS user_id,
    CASE WHEN role = 'system' THEN NULL ELSE upper(role) END AS user_name,
    (conv_id * 3 + turn * 5) % 17 = 0 AS private, CAST((conv_id * 5 + turn * 7) % 4 AS INTEGER) AS votes,
    (conv_id + turn * 3) % 13 = 0 AS skip
  FROM conversations)"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with real times from the ``events`` table: one conversation per user, list order by time."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), "event_id", F.col("ts").cast("timestamp").alias("time"),
        "event_type", "value", "props", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("_hour"))
    numbered = ordinal(events, ["conv_id"], [F.col("time"), F.col("event_id")], "_hour", "_position")
    return numbered.select(
        "conv_id",
        (F.col("_position") - 1).cast("int").alias("idx"),
        F.concat(F.lit("e"), "event_id").alias("msg_id"),
        "time",
        F.when(F.col("event_type").isin("click", "view"), "User").otherwise("Agent").alias("origin"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.col("event_type").alias("user_id"),
        F.upper("event_type").alias("user_name"),
        _every("event_id % 19").alias("private"),
        F.floor("value").cast("int").alias("votes"),
        F.when(_every("event_id % 23"), F.create_map(F.lit("skipAnalysis"), F.lit("true")))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("metadata"),
    )


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two very long conversations, each one user's, from the ``events`` table."""
    events = table(spark, sf_dir, "events").select(
        F.expr("user_id % 2").alias("conv_id"), "event_id", F.col("ts").cast("timestamp").alias("time"), "event_type",
        "value", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("_hour"))
    numbered = ordinal(events, ["conv_id"], [F.col("time"), F.col("event_id")], "_hour", "_position")
    return numbered.select(
        "conv_id", (F.col("_position") - 1).cast("int").alias("idx"), F.concat(F.lit("e"), "event_id").alias("msg_id"),
        "time", F.lit("User").alias("origin"), F.col("event_type").alias("content"), F.lit("one").alias("user_id"),
        F.lit("One").alias("user_name"), _every("event_id % 19").alias("private"),
        F.floor("value").cast("int").alias("votes"),
        F.when(_every("event_id % 23"), F.create_map(F.lit("skipAnalysis"), F.lit("true")))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("metadata"))


LONG_SQL = """msg AS (
  SELECT user_id % 2 AS conv_id,
    CAST(row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
    concat('e', event_id) AS msg_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t, 'User' AS origin,
    event_type AS content, 'one' AS user_id, event_id % 19 = 0 AS private, CAST(floor(value) AS INTEGER) AS votes,
    event_id % 23 = 0 AS skip
  FROM events)"""


def stored(df: DataFrame) -> DataFrame:
    """A derived table written once, for plans that read it several times."""
    return cut_lineage(df)


EVM_SQL = """msg AS (
  SELECT user_id AS conv_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
    concat('e', event_id) AS msg_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t,
    CASE WHEN event_type IN ('click', 'view') THEN 'User' ELSE 'Agent' END AS origin,
    concat(event_type, ' ', props) AS content, event_type AS user_id, upper(event_type) AS user_name,
    event_id % 19 = 0 AS private, CAST(floor(value) AS INTEGER) AS votes, event_id % 23 = 0 AS skip
  FROM events)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of the ``conversations`` table."""
    base = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("_top"))
    return base.select(
        "conv_id",
        F.expr("concat('o', conv_id % 3)").alias("owner"),
        F.expr("named_struct('id', concat('user', conv_id % 7), 'displayName', concat('User ', conv_id % 7), "
               "'phoneNumber', cast(null as string), 'email', concat('u', conv_id % 7, '@example.org'), "
               "'homeTown', cast(null as string))").alias("user"),
        F.expr("case when conv_id % 10 = 9 then 'Deleted' else "
               "element_at(array('New', 'Ongoing', 'Complete'), cast(conv_id % 3 as int) + 1) end").alias("status"),
        F.expr("map_from_entries(filter(array("
               "struct('support_area', case when conv_id % 6 = 0 then null else array(concat('s', conv_id % 5)) end),"
               "struct('channel_id', array(concat('c', conv_id % 50))),"
               "struct('tags', array_distinct(array(concat('t', conv_id % 4), concat('t', conv_id % 7)))),"
               "struct('token', array('secret'))), e -> e.col2 is not null))").alias("properties"),
        F.expr("named_struct('contextType', 'chat', 'environmentType', case when conv_id % 2 = 0 then 'web' end, "
               "'domain', concat('d', conv_id % 4), 'environment', map('lang', array('de'), 'void', "
               "cast(array() as array<string>), ' ', array('x')))").alias("context"),
        F.timestamp_seconds(F.expr(f"{EPOCH} + conv_id * 3600 + _top * 60")).alias("last_modified"),
        F.expr(f"case when conv_id % 10 = 9 then timestamp_seconds({EPOCH} + conv_id * 3600 + 3000) end")
        .alias("deleted"),
    )


CONV_SQL = f"""conv AS (
  SELECT conv_id, concat('o', conv_id % 3) AS owner, concat('user', conv_id % 7) AS user_id,
    CASE WHEN conv_id % 10 = 9 THEN 'Deleted'
         ELSE list_extract(['New', 'Ongoing', 'Complete'], conv_id % 3 + 1) END AS status,
    CASE WHEN conv_id % 6 = 0 THEN NULL ELSE concat('s', conv_id % 5) END AS support_area,
    concat('c', conv_id % 50) AS channel_id,
    CASE WHEN conv_id % 4 = conv_id % 7 THEN [concat('t', conv_id % 4)]
         ELSE [concat('t', conv_id % 4), concat('t', conv_id % 7)] END AS tags,
    concat('d', conv_id % 4) AS domain, 'chat' AS context_type,
    CASE WHEN conv_id % 2 = 0 THEN 'web' END AS environment_type,
    1000 * ({EPOCH} + conv_id * 3600 + max(turn) * 60) AS modified,
    CASE WHEN conv_id % 10 = 9 THEN 1000 * ({EPOCH} + conv_id * 3600 + 3000) END AS deleted
  FROM conversations GROUP BY conv_id)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")
