"""Streaming queries, run over all that is available and returned as tables."""

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, EVM_SQL, LONG_SQL, MSG_SQL
from parley.operators import filters as f
from parley.operators.annotate import index_tokens
from parley.plans.annotation import _tokens, _TOKENS_SQL
from parley.plans.registry import query
from parley.plans.sequences import HOURS6, LONG_GAP, _MERGED_SQL, _RUNS_SQL
from parley.plans.tables import scratch
from parley.sources import index, readers
from parley.streaming import runs, sync


def _stream(spark, df, name, files=4):
    """``df`` as files of a folder and the stream that reads them, one file per batch."""
    path = scratch(spark, name)
    df.repartition(files).write.parquet(path)
    return sync.changes(spark, path, spark.read.parquet(path).schema, max_files=1)


def _finish(spark, stream, each):
    sync.run(stream, each, scratch(spark, "cursor")).awaitTermination()


# Every conversation changes three times; the last change deletes those that are deleted.
def _conversation_changes(spark, sf):
    conv = ad.conversations(spark, sf).select("conv_id", "owner", "status", "last_modified", "deleted")
    version = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("v")
    return conv.select("*", version).withColumn(
        "last_modified", F.col("last_modified") + F.make_interval(secs=F.col("v"))).withColumn(
        "deleted", F.when(F.col("v") == 2, F.col("deleted"))).withColumn("label", F.concat_ws("-", "status", "v")).drop("v")


@query(f"WITH {CONV_SQL} SELECT conv_id, owner, concat(status, '-2') AS label, modified + 2000 AS synced FROM conv "
       "WHERE deleted IS NULL")
def sync_stream(spark, sf):
    path = scratch(spark, "index")
    stream = _stream(spark, _conversation_changes(spark, sf), "changes")
    _finish(spark, stream, sync.index_sink(spark, path, lambda updates: updates.drop("deleted")))
    docs = sync.live_docs(index.read_search_docs(spark, path))
    return docs.select("conv_id", "owner", "label", F.unix_millis("sync_date").alias("synced"))


@query(f"""WITH {CONV_SQL}, w AS (SELECT owner, conv_id, unnest(list_distinct([lower(status), '2', owner])) AS term FROM conv
  WHERE deleted IS NULL)
SELECT owner, term, count(*) AS df FROM w GROUP BY owner, term""")
def sync_stream_frequencies(spark, sf):
    """Document frequencies kept by the stream: each of the three changes takes the one before it back."""
    path, shape = scratch(spark, "index"), index.Shape(doc=("conv_id",), text="content", buckets=4)
    changed = _conversation_changes(spark, sf).withColumn("content", F.concat_ws(" ", "label", "owner"))
    _finish(spark, _stream(spark, changed, "changes"), sync.index_sink(
        spark, path, lambda updates: updates.drop("deleted"), shape=shape))
    return index.Index(spark, path, shape).frequencies().select("owner", "term", "df")


@query(f"""WITH {CONV_SQL}, {MSG_SQL}, {_RUNS_SQL.format(now='t', limit=30000)}
SELECT conv_id, -1 AS idx, 'conversation' AS type, (SELECT count(*) FROM msg m WHERE m.conv_id = conv.conv_id
  AND NOT private AND NOT skip) > 0 AS filled FROM conv WHERE deleted IS NULL
UNION ALL SELECT r.conv_id, min(r.idx), 'message', true FROM runs r JOIN conv USING (conv_id) WHERE deleted IS NULL
  GROUP BY r.conv_id, run""")
def rebuild_docs(spark, sf):
    """The table of all conversations, deleted ones too, rebuilt: only the living ones are left."""
    path = scratch(spark, "rebuild")
    assert sync.needs_rebuild(index.read_search_docs(spark, path))
    conv, msg = ad.conversations(spark, sf), ad.messages(spark, sf)
    sync.rebuild_docs(conv.withColumn("deleted", F.lit(None).cast("timestamp")), msg, path)
    sync.rebuild_docs(conv, msg, path)
    docs = index.read_search_docs(spark, path)
    return docs.select("conv_id", "idx", "type", F.coalesce(F.col("content") != "", F.lit(False)).alias("filled"))


@query("SELECT count(*) = 0 OR count(*) FILTER (n_chars % 10 <> 7) > 0 AS rebuild, max(epoch_ms(TIMESTAMP '2024-01-01') "
       "+ 1000 * doc_id) AS resume_ms FROM documents")
def needs_rebuild(spark, sf):
    docs = ad.documents(spark, sf).select((F.col("n_chars") % 10).alias("version"), F.timestamp_seconds(
        F.expr(f"{ad.EPOCH} + doc_id")).alias("sync_date"))
    outdated = f.outdated_count(docs).select(((F.col("docs") == 0) | (F.col("outdated") > 0)).alias("rebuild"))
    return outdated.withColumn("resume_ms", sync.resume_from(docs).select(F.unix_millis("last_sync")).scalar())


@query(f"""WITH {CONV_SQL} SELECT conv_id, CASE WHEN deleted IS NOT NULL THEN 'remove' ELSE 'index' END AS action FROM conv
WHERE deleted IS NOT NULL OR status = 'Complete'""")
def on_change(spark, sf):
    path = scratch(spark, "actions")
    conv = ad.conversations(spark, sf).select("conv_id", "status", F.when(
        F.col("deleted").isNotNull(), "DELETE").otherwise("SAVE").alias("operation"))
    stream = sync.on_change(_stream(spark, conv, "store-events"))
    query_run = (stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "cursor"))
                 .trigger(availableNow=True).start(path))
    query_run.awaitTermination()
    return spark.read.parquet(path).select("conv_id", "action")


@query(f"""WITH {EVM_SQL}, {_RUNS_SQL.format(now='us', limit=HOURS6 * 1000000)}
SELECT conv_id, idx, content, message_ids, votes FROM ({_MERGED_SQL})""")
def merge_consecutive_stream(spark, sf):
    return _streamed_runs(spark, ad.event_messages(spark, sf), HOURS6)[0]


@query(f"""WITH {LONG_SQL}, {_RUNS_SQL.format(now='us', limit=LONG_GAP * 1000000)}
SELECT conv_id, idx, content, message_ids, votes FROM ({_MERGED_SQL})""")
def merge_consecutive_stream_long(spark, sf):
    """Two conversations hold all messages."""
    return _streamed_runs(spark, ad.long_messages(spark, sf), LONG_GAP)[0]


@query(f"""WITH {EVM_SQL} SELECT conv_id, idx, content, msg_id AS message_ids, CAST(votes AS BIGINT) AS votes FROM msg
WHERE idx % 9 = 4 AND NOT private AND NOT skip""")
def late_messages(spark, sf):
    """Every ninth message comes after the watermark has passed all; they are a table of their own."""
    return _streamed_runs(spark, ad.event_messages(spark, sf), HOURS6, "idx % 9 = 4")[1]


def _streamed_runs(spark, msg, gap_s, held_back="false"):
    """Runs and late messages of a stream that brings a week after the other, each in files of any order.

    At last come messages of nobody that move the watermark beyond every run, and after it what was held back."""
    msg = ad.stored(msg)
    end = msg.agg(F.max("time").alias("time")).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).alias("idx"), F.lit("end").alias("msg_id"),
        (F.col("time") + F.expr("interval 30 days")).alias("time"), F.lit("User").alias("origin"),
        F.lit("").alias("content"), F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("user_name"), F.lit(False).alias("private"), F.lit(0).alias("votes"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"))
    path, out, late = (scratch(spark, name) for name in ("messages", "runs", "late"))
    week = F.date_trunc("week", "time")
    for row in msg.select(week.alias("week")).distinct().orderBy("week").collect():
        msg.filter(week == F.lit(row.week)).filter(f"not ({held_back})").repartition(2).write.mode("append").parquet(path)
    for nobody in (-1, -2):  # two files are a batch
        end.withColumn("conv_id", F.lit(nobody).cast("bigint")).write.mode("append").parquet(path)
    msg.filter(held_back).repartition(2).write.mode("append").parquet(path)
    stream = sync.changes(spark, path, msg.schema, max_files=2)
    merged = runs.merge_consecutive_stream(stream, gap_s, "9 days")
    _finish(spark, merged, runs.split_late(out, late))
    pieces = (spark.read.schema(merged.drop("late").schema).parquet(place).select(
        "conv_id", "idx", "part", "parts", "content", F.array_join("message_ids", ",").alias("message_ids"), "votes")
        for place in (out, late))
    return tuple(runs.whole_runs(table, {"content": "\n", "message_ids": ","}).select(
        "conv_id", "idx", "content", "message_ids", "votes") for table in pieces)


@query(f"WITH {CONV_SQL} SELECT conv_id, concat(status, '-2') AS label, deleted IS NOT NULL AS tombstone FROM conv")
def latest_state(spark, sf):
    path = scratch(spark, "state")
    stream = _stream(spark, _conversation_changes(spark, sf), "versions")
    _finish(spark, stream, sync.index_sink(spark, path, lambda updates: updates.drop("deleted")))
    return index.read_search_docs(spark, path).select("conv_id", "label", "tombstone")


@query("""SELECT lang AS client, concat(lang, '-', doc_id) AS id, CASE WHEN quality IS NOT NULL THEN concat('q', quality)
  ELSE source END AS data FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0""")
def chat_docs_sync(spark, sf):
    docs = ad.documents(spark, sf).select("doc_id", "lang", F.col("source").alias("data"), F.lit(0).alias("v"))
    labels = ad.table(spark, sf, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    newer = labels.select("doc_id", "lang", F.concat(F.lit("q"), "quality").alias("data"), F.lit(1).alias("v"), "toxic")
    changed = docs.withColumn("toxic", F.lit(0)).unionByName(newer).select(
        F.col("lang").alias("client"), F.concat_ws("-", "lang", "doc_id").alias("id"), "data",
        F.timestamp_seconds(F.expr(f"{ad.EPOCH} + v")).alias("modified"),
        F.when(F.col("toxic") == 1, F.timestamp_seconds(F.lit(ad.EPOCH))).alias("deleted"))
    path = scratch(spark, "chat-index")
    _finish(spark, _stream(spark, changed, "chat-changes"), sync.index_sink(
        spark, path, lambda updates: updates.drop("deleted"), "id", "modified"))
    return sync.live_docs(index.read_search_docs(spark, path)).select("client", "id", "data")


@query(f"""{_TOKENS_SQL}, {CONV_SQL} SELECT conv_id, modified + 2000 AS date, count(*) AS tokens,
  md5(string_agg(concat(type, ':', value), ' ' ORDER BY token_idx)) AS listed
FROM indexed JOIN conv USING (conv_id) GROUP BY conv_id, modified""")
def analysis_stream(spark, sf):
    """The token list of every changed conversation, kept current: of three changes of each the last one's is left."""
    path = scratch(spark, "analyses")
    stream = _stream(spark, _conversation_changes(spark, sf).select(
        "conv_id", F.col("last_modified").alias("date")), "analysis-changes")
    _, _, _, tokens = _tokens(spark, sf)

    def analyse(keys):
        listed = F.array_sort(F.collect_list(F.struct("token_idx", F.concat_ws(":", "type", "value").alias("t"))))
        return index_tokens(tokens.join(keys, "conv_id")).groupBy("conv_id", "date").agg(
            F.count(F.lit(1)).alias("tokens"), F.md5(F.array_join(F.transform(listed, lambda t: t["t"]), " ")).alias("listed"))

    _finish(spark, stream, sync.analysis_sink(spark, path, analyse))
    return index.read_search_docs(spark, path).select("conv_id", F.unix_millis("date").alias("date"), "tokens", "listed")


@query(f"WITH {EVM_SQL} SELECT conv_id, concat('m', idx) AS msg_id, CAST(votes + votes % 7 - 10 AS INTEGER) AS votes FROM msg")
def rate_messages_stream(spark, sf):
    """Message ids are the list positions, so that every conversation has the same ones."""
    path = scratch(spark, "votes")
    msg = ad.stored(ad.event_messages(spark, sf).select("conv_id", F.concat(F.lit("m"), "idx").alias("msg_id"), "votes"))
    deltas = msg.select("conv_id", "msg_id", F.explode(F.array(F.col("votes") % 7, F.lit(-10))).alias("delta"))
    _finish(spark, _stream(spark, deltas, "deltas"), sync.rating_sink(path))
    return sync.rated_messages(spark, msg, path)


@query(f"""WITH {MSG_SQL} SELECT concat('c', conv_id) AS conv_id, msg_id, t, origin, content, user_id FROM msg""")
def read_chat_events(spark, sf):
    path, out = scratch(spark, "events"), scratch(spark, "chat-messages")
    msg = ad.messages(spark, sf)
    msg.select(F.col("msg_id").alias("message_id"), F.concat(F.lit("c"), "conv_id").alias("channel_id"), "user_id",
               F.col("content").alias("text"), "origin", F.unix_millis("time").alias("timestamp")).repartition(3).write.json(
        path)
    messages = readers.chat_messages(readers.read_chat_events(spark, path, 1))
    (messages.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "cursor"))
     .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out).select("conv_id", "msg_id", F.unix_millis("time").alias("t"), "origin", "content",
                                          "user_id")
