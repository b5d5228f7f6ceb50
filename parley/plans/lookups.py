"""Predicates, look-ups, projections and simple aggregates."""

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, EVM_SQL, MSG_SQL
from parley.operators import filters as f
from parley.operators import windows as w
from parley.plans.registry import query
from parley.plans.retrieval import _docs
from parley.plans.sequences import _MERGED_SQL, _RUNS_SQL, _START_SQL, _context_sql

_CONV = f"WITH {CONV_SQL}"
_MSG = f"WITH {MSG_SQL}"


@query(f"{_CONV} SELECT conv_id, owner, status, modified FROM conv WHERE deleted IS NULL")
def not_deleted(spark, sf):
    return f.not_deleted(ad.conversations(spark, sf)).select(
        "conv_id", "owner", "status", F.unix_millis("last_modified").alias("modified"))


@query(f"""{_CONV} SELECT 'some' AS which, conv_id FROM conv WHERE owner IN ('o0', 'o2')
UNION ALL SELECT 'all', conv_id FROM conv""")
def owned_by(spark, sf):
    conv = ad.conversations(spark, sf)
    parts = [("some", f.owned_by(conv, ["o0", "o2"])), ("all", f.owned_by(conv, None)), ("none", f.owned_by(conv, []))]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("which"), "conv_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_CONV} SELECT conv_id FROM conv WHERE deleted IS NULL AND user_id = 'user3'")
def ids_by_user(spark, sf):
    return f.ids_by_user(ad.conversations(spark, sf), "user3")


@query(f"""{_CONV} SELECT channel_id, max_by(conv_id, (modified, conv_id)) AS conv_id FROM conv
WHERE deleted IS NULL AND status <> 'Complete' GROUP BY channel_id""")
def current_by_channel(spark, sf):
    return f.current_by_channel(ad.conversations(spark, sf))


@query(f"""{_CONV} SELECT conv_id, owner FROM conv WHERE deleted IS NULL AND owner = 'o1' AND context_type = 'chat'
AND channel_id = 'c7'""")
def find_by_channel(spark, sf):
    return f.find_by_channel(ad.conversations(spark, sf), "o1", "chat", "c7").select("conv_id", "owner")


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, {_RUNS_SQL.format(now='t', limit=30000)}
SELECT DISTINCT conv_id, run, owner FROM runs JOIN conv USING (conv_id)
WHERE deleted IS NULL AND status = 'Complete' AND conv_id <> 4""")
def completed_only(spark, sf):
    docs = f.exclude_conversation(f.completed_only(_docs(spark, sf)), 4)
    return docs.select("conv_id", "run", "owner")


@query(f"""{_CONV} SELECT conv_id, 'value' AS which FROM conv WHERE support_area IN ('s1', 's3')
UNION ALL SELECT conv_id, 'missing' FROM conv WHERE support_area IS NULL""")
def property_filter(spark, sf):
    conv = ad.conversations(spark, sf)
    some = f.property_filter(conv, {"support_area": ["s1", " ", "s3"]})
    none = f.property_filter(conv, {"support_area": [" "]})
    return some.select("conv_id", F.lit("value").alias("which")).unionByName(
        none.select("conv_id", F.lit("missing").alias("which")))


@query("SELECT doc_id FROM documents WHERE n_chars > 100 AND lang = 'en'")
def apply_named_filters(spark, sf):
    filters = [{"name": "long", "condition": "n_chars > 100"},
               {"name": "lang", "condition": "lang = 'en'", "optional": True, "enabled": False},
               {"name": "source", "condition": "source = 'src1'", "optional": True, "enabled": True}]
    return f.apply_named_filters(ad.documents(spark, sf), filters, {"lang": True, "source": False}).select("doc_id")


@query(f"{_MSG} SELECT conv_id, idx, msg_id FROM msg WHERE NOT private AND NOT skip")
def indexable_messages(spark, sf):
    return w.indexable_messages(ad.messages(spark, sf)).select("conv_id", "idx", "msg_id")


@query(f"""{_MSG} SELECT conv_id, idx AS msg_idx, origin, content AS text FROM msg
WHERE NOT skip AND regexp_matches(content, '\\S')""")
def build_sections(spark, sf):
    return f.build_sections(ad.messages(spark, sf))


_SECTIONS_SQL = f"""{_MSG}, sections AS (SELECT conv_id, idx AS msg_idx, content AS text FROM msg
  WHERE NOT skip AND regexp_matches(content, '\\S'))"""


@query(f"""{_SECTIONS_SQL} SELECT conv_id, msg_idx, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id
  ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sections""")
def section_offsets(spark, sf):
    return f.section_offsets(f.build_sections(ad.messages(spark, sf)), rows=2).select("conv_id", "msg_idx", "offset")


@query(f"""{_SECTIONS_SQL} SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY msg_idx)) AS content FROM sections
GROUP BY conv_id""")
def section_content(spark, sf):
    return f.section_content(f.build_sections(ad.messages(spark, sf)), rows=2).select(
        "conv_id", F.md5("content").alias("content"))


@query(f"""{_CONV}, pairs AS (SELECT a.conv_id AS query_id, b.conv_id FROM conv a JOIN conv b
  ON b.conv_id > a.conv_id AND b.conv_id <= a.conv_id + 30)
SELECT query_id, p.conv_id FROM pairs p JOIN conv a ON a.conv_id = query_id JOIN conv b ON b.conv_id = p.conv_id
WHERE a.support_area IS NOT DISTINCT FROM b.support_area AND list_has_any(a.tags, b.tags) AND b.status = 'Complete'""")
def matching_pairs(spark, sf):
    conv = ad.conversations(spark, sf).select(
        "conv_id", "properties", (F.col("status") == "Complete").alias("completed"))
    ahead = F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + 30)).alias("conv_id")
    pairs = conv.select(F.col("conv_id").alias("query_id"), ahead)
    return f.matching_pairs(pairs, conv, conv, ["support_area", "tags"], completed=True)


@query(f"""{_CONV} SELECT conv_id, concat_ws(';', 'env_lang=de',
  concat('meta_channel_id=', channel_id),
  CASE WHEN support_area IS NOT NULL THEN concat('meta_support_area=', support_area) END,
  concat('meta_tags=', array_to_string(tags, ','))) AS fields FROM conv""")
def flatten_properties(spark, sf):
    flat = f.flatten_properties(ad.conversations(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("fields")),
                          lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return flat.select("conv_id", F.array_join(entries, ";").alias("fields"))


_TEXTS_SQL = """SELECT conv_id, string_agg(content, '|' ORDER BY idx) AS texts FROM msg
  WHERE NOT private AND NOT skip GROUP BY conv_id"""


@query(f"""WITH {EVM_SQL} SELECT conv_id, count(*) AS message_count, min_by(t, idx) AS start_ms, max_by(t, idx) AS end_ms
FROM msg GROUP BY conv_id""")
def conversation_rollup(spark, sf):
    return f.conversation_rollup(ad.event_messages(spark, sf)).select(
        "conv_id", "message_count", F.unix_millis("start_time").alias("start_ms"),
        F.unix_millis("end_time").alias("end_ms"))


@query(f"""WITH {MSG_SQL}, {CONV_SQL},
r AS (SELECT conv_id, count(*) AS message_count, min_by(t, idx) AS start_ms, max_by(t, idx) AS end_ms
  FROM msg GROUP BY conv_id), x AS ({_TEXTS_SQL})
SELECT conv_id, owner, 'conversation' AS type, 7 AS version, status = 'Complete' AS completed, modified,
  context_type AS "contextType", environment_type AS "environmentType", domain, message_count, start_ms, end_ms, texts
FROM conv LEFT JOIN r USING (conv_id) LEFT JOIN x USING (conv_id)""")
def conversation_docs(spark, sf):
    docs = f.conversation_docs(ad.conversations(spark, sf), ad.messages(spark, sf))
    return docs.select(
        "conv_id", "owner", "type", "version", "completed", F.unix_millis("modified").alias("modified"), "contextType",
        "environmentType", "domain", "message_count", F.unix_millis("start_time").alias("start_ms"),
        F.unix_millis("end_time").alias("end_ms"), F.array_join("messages", "|").alias("texts"))


_CONTEXT_CTE = _context_sql(MSG_SQL, "t").format(k=1000).replace("SELECT conv_id, idx, CAST(least(", "ctx AS ("
               "SELECT conv_id, idx, CAST(least(", 1).replace("greatest(high, least(n - 1, idx + 1)) AS INTEGER) "
               "AS \"end\" FROM ends", "greatest(high, least(n - 1, idx + 1)) AS INTEGER) AS \"end\" FROM ends", 1)
_CONTEXT_CTE = _CONTEXT_CTE.replace("GROUP BY conv_id, idx, n)\nctx", "GROUP BY conv_id, idx, n),\nctx", 1) + ")"
_MESSAGE_DOCS_SQL = f"""{_CONTEXT_CTE}, {CONV_SQL}, {_RUNS_SQL.format(now='t', limit=30000)}, merged AS ({_MERGED_SQL}),
mdocs AS (SELECT concat(conv_id, '_', CASE WHEN trim(msg_id) = '' THEN CAST(idx AS VARCHAR) ELSE msg_id END) AS id,
  conv_id, idx, owner, status = 'Complete' AS completed, content, merged.votes, ctx.start AS context_start,
  ctx."end" AS context_end FROM merged JOIN ctx USING (conv_id, idx) JOIN conv USING (conv_id))"""


@query(f"{_MESSAGE_DOCS_SQL} SELECT * FROM mdocs")
def message_docs(spark, sf):
    docs = f.message_docs(ad.conversations(spark, sf), ad.messages(spark, sf))
    return docs.select("id", "conv_id", "idx", "owner", "completed", "content", "votes", "context_start",
                       "context_end")


@query(f"""{_MESSAGE_DOCS_SQL} SELECT d.conv_id, d.idx AS doc_idx, string_agg(m.content, '|' ORDER BY m.idx) AS context
FROM mdocs d JOIN msg m ON m.conv_id = d.conv_id AND m.idx >= context_start AND m.idx < context_end
WHERE NOT m.private GROUP BY d.conv_id, d.idx""")
def context_texts(spark, sf):
    msg = ad.messages(spark, sf)
    docs = f.message_docs(ad.conversations(spark, sf), msg)
    return f.context_texts(docs, msg).withColumn("context", F.array_join("context", "|"))


@query(f"{_CONV} SELECT conv_id, status, domain FROM conv")
def public_view(spark, sf):
    conv = ad.conversations(spark, sf).select("conv_id", "status", "context.domain", "owner", "deleted",
                                              F.col("last_modified").alias("sync_date"))
    return f.public_view(conv)


@query("""SELECT source AS title, concat('https://example.org/', doc_id) AS link,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS type, 1000 * (1704067200 + doc_id) AS date
FROM documents WHERE doc_id % 7 <> 0""")
def map_results(spark, sf):
    docs = ad.documents(spark, sf).select(
        F.expr("case when doc_id % 7 = 0 then null else source end").alias("name"),
        F.array(F.concat(F.lit("https://example.org/"), "doc_id"), F.lit("other")).alias("urls"),
        F.expr("case when doc_id % 3 = 0 then null else concat('org.text.', lang) end").alias("kind"),
        F.timestamp_seconds(F.expr("1704067200 + doc_id")).alias("created"))
    return f.map_results(docs, {"title": "name", "link": "urls", "type": "kind", "date": "created", "thumb": ""})


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents "
       "ORDER BY n_chars DESC, doc_id OFFSET 40 LIMIT 20")
def page(spark, sf):
    docs = ad.documents(spark, sf)
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return f.page(docs.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 2, 20).withColumn(
        "total", total)


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') "
       "OR starts_with(c_mktsegment, 'Customer#00000001')")
def prefix_search(spark, sf):
    users = ad.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    return f.prefix_search(users, "Customer#00000001", ["c_name", "segment"]).select("c_custkey", "c_name")


# Ids that are asked for: those of every message, with one that does not exist per conversation.
_WANTED_SQL = """wanted AS (SELECT conv_id, msg_id FROM msg WHERE msg_id <> ''
  UNION ALL SELECT DISTINCT conv_id, 'nobody' FROM msg)"""


def _wanted(msg):
    return msg.filter("msg_id <> ''").select("conv_id", "msg_id").unionByName(
        msg.select("conv_id", F.lit("nobody").alias("msg_id")).distinct())


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, {_WANTED_SQL} SELECT conv_id, idx, msg_id, content FROM msg
JOIN wanted USING (conv_id, msg_id) JOIN conv USING (conv_id) WHERE deleted IS NULL""")
def find_message(spark, sf):
    msg = ad.messages(spark, sf)
    return f.find_message(ad.conversations(spark, sf), msg, _wanted(msg)).select(
        "conv_id", "idx", "msg_id", "content")


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, {_WANTED_SQL} SELECT conv_id, msg_id, msg_id <> 'nobody' AND deleted IS NULL
AS found FROM wanted JOIN conv USING (conv_id)""")
def exists_message(spark, sf):
    msg = ad.messages(spark, sf)
    return f.exists_message(ad.conversations(spark, sf), msg, _wanted(msg))


@query(f"""{_CONV}, asked AS (SELECT conv_id * 2 AS conv_id FROM conv)
SELECT a.conv_id, c.conv_id IS NOT NULL AS found FROM asked a LEFT JOIN conv c
  ON c.conv_id = a.conv_id AND c.deleted IS NULL""")
def exists_conversation(spark, sf):
    conv = ad.conversations(spark, sf)
    return f.exists_conversation(conv, conv.select((F.col("conv_id") * 2).alias("conv_id")))


@query(f"{_CONV} SELECT conv_id FROM conv WHERE deleted IS NULL")
def live_ids(spark, sf):
    return f.live_ids(ad.conversations(spark, sf))


@query(f"""WITH {EVM_SQL}{_START_SQL} SELECT DISTINCT conv_id, user_id FROM msg JOIN starts USING (conv_id)
WHERE idx >= start""")
def context_users(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    return f.context_users(msg, w.context_start(msg))


@query(f"""WITH {EVM_SQL}{_START_SQL} SELECT conv_id, idx, msg_id FROM msg JOIN starts USING (conv_id)
WHERE idx >= start""")
def context_message_ids(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    return f.context_message_ids(msg, w.context_start(msg))


@query(f"{_MSG}, {CONV_SQL} SELECT conv_id, idx, msg_id FROM msg WHERE conv_id IN (SELECT conv_id FROM conv "
       "WHERE user_id = 'user3' AND deleted IS NULL)")
def list_messages(spark, sf):
    wanted = f.ids_by_user(ad.conversations(spark, sf), "user3")
    return f.list_messages(ad.messages(spark, sf), wanted).select("conv_id", "idx", "msg_id")


@query("""SELECT n_name AS client, concat('b', r_regionkey) AS type, concat(r_name, '-', n_nationkey) AS name,
  true AS enabled FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0""")
def select_settings(spark, sf):
    return f.select_settings(_settings(spark, sf), "queryBuilder")


def _settings(spark, sf):
    """Component settings per nation: one enabled or disabled query builder named after its region."""
    region = ad.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = ad.table(spark, sf, "nation").join(region, "n_regionkey")
    component = F.struct(
        F.concat(F.lit("b"), "n_regionkey").alias("type"), F.concat_ws("-", "r_name", "n_nationkey").alias("name"),
        (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    return joined.select(F.col("n_name").alias("client"),
                         F.create_map(F.lit("queryBuilder"), F.array(component)).alias("config"))


@query("""WITH keys(key, value) AS (VALUES ('rows', '10'), ('lang', 'de')),
own AS (SELECT n_name AS client, 'rows' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation
  WHERE n_nationkey % 3 = 0)
SELECT n_name AS client, keys.key, coalesce(own.value, keys.value) AS value FROM nation CROSS JOIN keys
  LEFT JOIN own ON own.client = n_name AND own.key = keys.key""")
def client_settings(spark, sf):
    nation = ad.table(spark, sf, "nation")
    own = nation.filter("n_nationkey % 3 = 0").select(
        F.col("n_name").alias("client"), F.lit("rows").alias("key"),
        F.col("n_nationkey").cast("string").alias("value"))
    return f.client_settings(nation.select(F.col("n_name").alias("client")), own, {"rows": "10", "lang": "de"})


@query(f"{_CONV}, t AS (SELECT unnest(tags) AS tag FROM conv WHERE deleted IS NULL) "
       "SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 4 OFFSET 1")
def tag_counts(spark, sf):
    return f.tag_counts(ad.conversations(spark, sf), 4, 1)


@query(f"{_CONV}, t AS (SELECT unnest(tags) AS tag FROM conv WHERE deleted IS NULL) "
       "SELECT DISTINCT tag FROM t WHERE regexp_matches(tag, 't[1-5]') ORDER BY tag LIMIT 3")
def tags_matching(spark, sf):
    return f.tags_matching(ad.conversations(spark, sf), "t[1-5]", 3)


_SINCE_MS = 1704067200000 + 3600000 * 20


@query(f"{_CONV} SELECT conv_id, modified FROM conv WHERE modified >= {_SINCE_MS} ORDER BY modified, conv_id LIMIT 25")
def updated_since(spark, sf):
    since = F.timestamp_millis(F.lit(_SINCE_MS))
    return f.updated_since(ad.conversations(spark, sf), since, 25).select(
        "conv_id", F.unix_millis("last_modified").alias("modified"))


@query(f"{_CONV} SELECT coalesce(max(modified), {_SINCE_MS}) AS cursor FROM (SELECT modified, conv_id FROM conv WHERE modified >= "
       f"{_SINCE_MS} ORDER BY modified, conv_id LIMIT 25)")
def next_cursor(spark, sf):
    since = F.timestamp_millis(F.lit(_SINCE_MS))
    batch = f.updated_since(ad.conversations(spark, sf), since, 25)
    return f.next_cursor(batch, since).select(F.unix_millis("cursor").alias("cursor"))


@query(f"{_CONV} SELECT max(modified) + 1 AS cursor FROM conv")
def next_cursor_at_the_end(spark, sf):
    """Nothing is newer than the last change, so the next batch begins a millisecond later."""
    conv = ad.conversations(spark, sf)
    since = conv.agg(F.max("last_modified").alias("since"))
    last = f.updated_since(conv, since.scalar(), 25)
    return f.next_cursor(last, since.scalar()).select(F.unix_millis("cursor").alias("cursor"))


@query("SELECT count(*) AS docs, count(*) FILTER (n_chars % 10 <> 7) AS outdated FROM documents")
def outdated_count(spark, sf):
    return f.outdated_count(ad.documents(spark, sf).select((F.col("n_chars") % 10).alias("version")))


@query(f"{_CONV} SELECT max(modified) AS last_sync FROM conv")
def last_sync(spark, sf):
    docs = ad.conversations(spark, sf).withColumnRenamed("last_modified", "sync_date")
    return f.last_sync(docs).select(F.unix_millis("last_sync").alias("last_sync"))


@query(f"""{_CONV} SELECT count(*) AS processed, count(deleted) AS removed, count(*) - count(deleted) AS updated,
round(100.0 * (count(*) - count(deleted)) / count(*), 4) AS updated_percent FROM conv""")
def sync_counters(spark, sf):
    return f.sync_counters(ad.conversations(spark, sf))


@query(f"{_CONV} SELECT conv_id, deleted IS NOT NULL AS removal FROM conv")
def split_changes(spark, sf):
    updates, removals = f.split_changes(ad.conversations(spark, sf))
    return updates.select("conv_id", F.lit(False).alias("removal")).unionByName(
        removals.select("conv_id", F.lit(True).alias("removal")))


@query("SELECT DISTINCT n_name AS owner FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey % 2 = 0")
def accessible_owners(spark, sf):
    nation = ad.table(spark, sf, "nation").withColumnRenamed("n_name", "owner")
    requested = nation.filter("n_regionkey in (1, 2)").select("owner")
    return f.accessible_owners(requested, nation.filter("n_nationkey % 2 = 0").select("owner"))


@query("""SELECT lang, doc_id, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3""")
def top_per_key(spark, sf):
    docs = ad.documents(spark, sf).select("lang", "doc_id", "n_chars")
    return f.top_per_key(docs, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3)
