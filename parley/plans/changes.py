"""Changes to stored tables."""

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, EVM_SQL, MSG_SQL
from parley.operators import merge as m
from parley.plans.registry import query

NOW_MS = 1735689600000


def _now():
    return F.timestamp_millis(F.lit(NOW_MS))


def _tagged(**tables):
    """Several result tables as one, told apart by ``part``."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


# Every stored message arrives once more: one in five with its own id (a replacement), the others as new messages.
_NEW_SQL = """new AS (SELECT conv_id, idx AS seq, CASE WHEN idx % 5 = 0 THEN msg_id ELSE concat('n', msg_id) END AS msg_id,
  concat('new ', content) AS content FROM msg WHERE msg_id <> '')"""


def _new_messages(msg):
    return msg.filter("msg_id <> ''").withColumn("seq", F.col("idx")).drop("idx").withColumn(
        "msg_id", F.expr("case when seq % 5 = 0 then msg_id else concat('n', msg_id) end")).withColumn(
        "content", F.concat(F.lit("new "), "content"))


@query(f"""WITH {EVM_SQL}, {_NEW_SQL},
allm AS (SELECT m.conv_id, m.idx AS pos, m.msg_id, coalesce(n.content, m.content) AS content
    FROM msg m LEFT JOIN new n ON n.conv_id = m.conv_id AND n.msg_id = m.msg_id
  UNION ALL SELECT conv_id, 1000000 + seq, msg_id, content FROM new WHERE seq % 5 <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS p,
  count(*) OVER (PARTITION BY conv_id) AS n FROM allm)
SELECT conv_id, CAST(p - 1 - greatest(0, n - 100) AS INTEGER) AS idx, msg_id, content FROM placed WHERE p > n - 100""")
def append_messages(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    conv = msg.select("conv_id", F.lit(None).cast("timestamp").alias("deleted")).distinct()
    merged, _ = m.append_messages(conv, msg, _new_messages(msg), _now(), cap=100)
    return merged.select("conv_id", "idx", "msg_id", "content")


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, {_NEW_SQL}
SELECT conv_id, msg_id, 'no such conversation' AS reason FROM new JOIN conv USING (conv_id) WHERE deleted IS NOT NULL""")
def append_messages_rejected(spark, sf):
    msg = ad.messages(spark, sf)
    _, rejected = m.append_messages(ad.conversations(spark, sf), msg, _new_messages(msg), _now())
    return rejected.select("conv_id", "msg_id", "reason")


@query(f"""WITH {EVM_SQL}, {_NEW_SQL}
SELECT 'stored' AS part, m.conv_id, m.msg_id, coalesce(n.content, m.content) AS content
  FROM msg m LEFT JOIN new n ON n.conv_id = m.conv_id AND n.msg_id = m.msg_id
UNION ALL SELECT 'rejected', conv_id, msg_id, content FROM new WHERE seq % 5 <> 0
UNION ALL SELECT 'rejected', conv_id, msg_id, concat('first ', content) FROM new WHERE seq % 2 = 0""")
def update_message(spark, sf):
    """Half of the messages are changed twice; the later change counts."""
    msg = ad.stored(ad.event_messages(spark, sf))
    new = _new_messages(msg)
    twice = new.filter("seq % 2 = 0").withColumn("content", F.concat(F.lit("first "), "content")).withColumn(
        "seq", F.col("seq") - 1_000_000_000)
    stored, unmatched = m.update_message(msg, new.unionByName(twice), "seq")
    columns = ["conv_id", "msg_id", "content"]
    return _tagged(stored=stored.select(*columns), rejected=unmatched.select(*columns))


@query(f"""WITH {EVM_SQL} SELECT conv_id, msg_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS INTEGER) AS idx FROM msg WHERE idx % 4 <> 1""")
def delete_message(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    return m.delete_message(msg, msg.filter("idx % 4 = 1")).select("conv_id", "msg_id", "idx")


@query(f"""WITH {EVM_SQL}, d AS (SELECT conv_id, msg_id, CAST(idx % 3 - 1 + 2 AS INTEGER) AS delta FROM msg
  WHERE idx % 2 = 0)
SELECT m.conv_id, m.msg_id, CAST(votes + coalesce(delta, 0) AS INTEGER) AS votes
FROM msg m LEFT JOIN d USING (conv_id, msg_id)""")
def adjust_votes(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    even = msg.filter("idx % 2 = 0")
    deltas = even.select("conv_id", "msg_id", F.expr("idx % 3 - 1").alias("delta")).unionByName(
        even.select("conv_id", "msg_id", F.lit(2).alias("delta")))
    return m.adjust_votes(msg, deltas).select("conv_id", "msg_id", "votes")


_PATHS = ["status", "meta.note", "context.domain", "environment.lang", "context.other", "other.x", ""]
_PATHS_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"


def _field_changes(conv):
    paths = F.array(*[F.lit(p) for p in _PATHS])
    return conv.select("conv_id", F.expr("conv_id % 13").alias("seq"),
                       F.element_at(paths, F.expr("cast(conv_id % 7 as int) + 1")).alias("path"),
                       F.expr("case when conv_id % 2 = 0 then 'Complete' else 'other' end").alias("value"))


@query(f"""WITH {CONV_SQL}, ch AS (SELECT *, list_extract({_PATHS_SQL}, conv_id % 7 + 1) AS path,
  CASE WHEN conv_id % 2 = 0 THEN 'Complete' ELSE 'other' END AS value FROM conv),
ok AS (SELECT *, deleted IS NULL AND (path IN ('meta.note', 'context.domain', 'environment.lang')
  OR (path = 'status' AND value = 'Complete')) AS valid FROM ch)
SELECT 'stored' AS part, conv_id, CASE WHEN valid AND path = 'status' THEN value ELSE status END AS status,
  CASE WHEN valid AND path = 'context.domain' THEN value ELSE domain END AS domain,
  CASE WHEN valid AND path = 'environment.lang' THEN value ELSE 'de' END AS lang,
  CASE WHEN valid AND path = 'meta.note' THEN value END AS note, valid AS changed FROM ok
UNION ALL SELECT 'rejected', conv_id, value, path, NULL,
  CASE WHEN deleted IS NOT NULL THEN 'no such conversation' ELSE 'field or value not supported' END, NULL
FROM ok WHERE NOT valid""")
def set_field(spark, sf):
    conv = ad.conversations(spark, sf)
    stored, rejected = m.set_field(conv, _field_changes(conv), _now())
    return _tagged(
        stored=stored.select("conv_id", "status", "context.domain",
                             F.get(F.try_element_at("context.environment", F.lit("lang")), F.lit(0)).alias("lang"),
                             F.get(F.try_element_at("properties", F.lit("note")), F.lit(0)).alias("note"),
                             (F.col("last_modified") == _now()).alias("changed")),
        rejected=rejected.select("conv_id", F.col("value").alias("status"), F.col("path").alias("domain"),
                                 F.lit(None).cast("string").alias("lang"), F.col("reason").alias("note"),
                                 F.lit(None).cast("boolean").alias("changed")))


@query(f"""WITH {CONV_SQL}, ch AS (SELECT *, list_extract(['channel_id', 'context.domain', 'environment.lang', 'status'],
  conv_id % 4 + 1) AS path FROM conv)
SELECT conv_id, CASE WHEN deleted IS NULL AND path = 'channel_id' THEN NULL ELSE channel_id END AS channel_id,
  CASE WHEN deleted IS NULL AND path = 'context.domain' THEN NULL ELSE domain END AS domain,
  CASE WHEN deleted IS NULL AND path = 'environment.lang' THEN NULL ELSE 'de' END AS lang, status FROM ch""")
def unset_field(spark, sf):
    conv = ad.conversations(spark, sf)
    paths = F.array(*[F.lit(p) for p in ("channel_id", "context.domain", "environment.lang", "status")])
    changes = conv.select("conv_id", F.lit(0).alias("seq"),
                          F.element_at(paths, F.expr("cast(conv_id % 4 as int) + 1")).alias("path"))
    stored, _ = m.unset_field(conv, changes, _now())
    return stored.select(
        "conv_id", F.get(F.try_element_at("properties", F.lit("channel_id")), F.lit(0)).alias("channel_id"),
        "context.domain", F.get(F.try_element_at("context.environment", F.lit("lang")), F.lit(0)).alias("lang"),
        "status")


@query(f"""WITH {EVM_SQL} SELECT 'stored' AS part, conv_id, msg_id,
  CAST(CASE WHEN idx % 3 = 0 THEN idx ELSE votes END AS INTEGER) AS votes FROM msg
UNION ALL SELECT 'rejected', conv_id, msg_id, NULL FROM msg WHERE idx % 3 = 1""")
def set_message_field(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    changes = msg.filter("idx % 3 < 2").select("conv_id", "msg_id", F.expr(
        "case when idx % 3 = 0 then cast(idx as string) else 'many' end").alias("value"))
    stored, rejected = m.set_message_field(msg, changes, "votes")
    return _tagged(stored=stored.select("conv_id", "msg_id", "votes"),
                   rejected=rejected.select("conv_id", "msg_id", F.lit(None).cast("int").alias("votes")))


@query(f"""WITH {CONV_SQL} SELECT conv_id, CASE WHEN deleted IS NULL AND owner = 'o1' THEN 'Complete' ELSE status END
AS status FROM conv""")
def set_status(spark, sf):
    conv = ad.conversations(spark, sf)
    stored, _ = m.set_status(conv, conv.filter("owner = 'o1'"), "Complete", _now())
    return stored.select("conv_id", "status")


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, x AS (SELECT *, deleted IS NULL AND owner = 'o2' AS gone FROM conv)
SELECT 'conversations' AS part, conv_id, CASE WHEN gone THEN 'Deleted' ELSE status END AS label,
  CASE WHEN gone THEN NULL ELSE user_id END AS user_id, CASE WHEN gone THEN {NOW_MS} ELSE deleted END AS deleted FROM x
UNION ALL SELECT 'messages', conv_id, msg.msg_id, msg.user_id, NULL FROM msg JOIN x USING (conv_id) WHERE NOT gone
UNION ALL SELECT 'analyses', conv_id, 'a', NULL, NULL FROM x WHERE NOT gone""")
def mark_deleted(spark, sf):
    conv, msg = ad.conversations(spark, sf), ad.messages(spark, sf)
    marked, messages, analyses = m.mark_deleted(
        conv, msg, conv.select("conv_id", F.lit("a").alias("label")), conv.filter("owner = 'o2'"), _now())
    none = F.lit(None)
    return _tagged(
        conversations=marked.select("conv_id", F.col("status").alias("label"), F.col("user.id").alias("user_id"),
                                    F.unix_millis("deleted").alias("deleted")),
        messages=messages.select("conv_id", F.col("msg_id").alias("label"), "user_id",
                                 none.cast("long").alias("deleted")),
        analyses=analyses.select("conv_id", "label", none.cast("string").alias("user_id"),
                                 none.cast("long").alias("deleted")))


_SEEN_MS = 1704067200000 + 3600000 * 50


@query(f"""WITH {CONV_SQL} SELECT 'stored' AS part, conv_id,
  CASE WHEN modified <= {_SEEN_MS} AND deleted IS NULL THEN 'Ongoing' ELSE status END AS label FROM conv
UNION ALL SELECT 'conflict', conv_id, CASE WHEN deleted IS NOT NULL THEN 'no such conversation' ELSE 'modified later' END
FROM conv WHERE NOT (modified <= {_SEEN_MS} AND deleted IS NULL)""")
def save_if_unmodified(spark, sf):
    conv = ad.conversations(spark, sf)
    new = conv.withColumn("status", F.lit("Ongoing")).withColumn("seen", F.timestamp_millis(F.lit(_SEEN_MS)))
    stored, conflicts = m.save_if_unmodified(conv, new, _now())
    return _tagged(stored=stored.select("conv_id", F.col("status").alias("label")),
                   conflict=conflicts.select("conv_id", F.col("reason").alias("label")))


@query(f"""WITH {MSG_SQL}, c AS (SELECT conv_id, count(*) AS n FROM msg GROUP BY conv_id)
SELECT conv_id, msg_id, n = 4 AS accepted FROM msg JOIN c USING (conv_id)""")
def append_if_size(spark, sf):
    msg = ad.messages(spark, sf)
    accepted, conflicts = m.append_if_size(msg, msg.withColumn("expected_size", F.lit(4)))
    return accepted.select("conv_id", "msg_id", F.lit(True).alias("accepted")).unionByName(
        conflicts.select("conv_id", "msg_id", F.lit(False).alias("accepted")))


@query(f"""WITH {CONV_SQL}, stored AS (SELECT conv_id, owner AS client, modified AS date FROM conv),
new AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN owner ELSE 'else' END AS client, modified + 5 AS date FROM conv)
SELECT conv_id, client, max(date) AS date FROM (SELECT * FROM stored UNION ALL SELECT * FROM new) GROUP BY ALL""")
def upsert_analysis(spark, sf):
    stored = ad.conversations(spark, sf).select(
        "conv_id", F.col("owner").alias("client"), F.unix_millis("last_modified").alias("date"))
    client = F.expr("case when conv_id % 2 = 0 then client else 'else' end")
    new = stored.select("conv_id", client.alias("client"), F.explode(F.array(
        F.col("date") + 5, F.col("date") + 1)).alias("date"))
    return m.upsert_analysis(stored, new)


def _chat_docs(spark, sf):
    """Stored chat documents: the tenant is the language."""
    return ad.documents(spark, sf).select(
        F.col("lang").alias("client"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("data"),
        F.lit(False).alias("removed"), F.timestamp_seconds(F.expr("1704067200 + doc_id")).alias("modified"))


def _chat_view(docs):
    return docs.select("client", "id", "data", "removed", F.unix_millis("modified").alias("modified"))


@query(f"""WITH d AS (SELECT lang AS client, concat('d', doc_id) AS id, source AS data, doc_id,
    1000 * (1704067200 + doc_id) AS modified FROM documents)
SELECT client, id, CASE WHEN l.quality IS NOT NULL THEN concat('q', l.quality) ELSE data END AS data,
  false AS removed, CASE WHEN l.quality IS NOT NULL THEN {NOW_MS} ELSE modified END AS modified
FROM d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'new', concat('d', doc_id), concat('t', toxic), false, {NOW_MS} FROM labels""")
def upsert_chat_docs(spark, sf):
    labels = ad.table(spark, sf, "labels").join(ad.documents(spark, sf).select("doc_id", "lang"), "doc_id")
    docs_id = F.concat(F.lit("d"), "doc_id").alias("id")
    first = labels.select(F.col("lang").alias("client"), docs_id, F.lit("old").alias("data"), F.lit(0).alias("seq"))
    second = labels.select(F.col("lang").alias("client"), docs_id, F.concat(F.lit("q"), "quality").alias("data"),
                           F.lit(1).alias("seq"))
    other = labels.select(F.lit("new").alias("client"), docs_id, F.concat(F.lit("t"), "toxic").alias("data"),
                          F.lit(0).alias("seq"))
    return _chat_view(m.upsert_chat_docs(_chat_docs(spark, sf), first.unionByName(second).unionByName(other), _now()))


@query(f"""WITH d AS (SELECT lang AS client, concat('d', doc_id) AS id, source AS data,
    1000 * (1704067200 + doc_id) AS modified, lang = 'fr' OR (lang = 'en' AND toxic = 1) AS gone
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT client, id, CASE WHEN coalesce(gone, false) THEN NULL ELSE data END AS data, coalesce(gone, false) AS removed,
  CASE WHEN coalesce(gone, false) THEN {NOW_MS} ELSE modified END AS modified FROM d""")
def remove_chat_docs(spark, sf):
    toxic = ad.table(spark, sf, "labels").filter("toxic = 1")
    single = toxic.select(F.lit("en").alias("client"), F.concat(F.lit("d"), "doc_id").alias("id"))
    whole = toxic.select(F.lit("fr").alias("client"), F.lit(None).cast("string").alias("id"))
    return _chat_view(m.remove_chat_docs(_chat_docs(spark, sf), single.unionByName(whole), _now()))


def _legacy(spark, sf):
    """Conversations in an older shape: channel and area in the environment, tags in a column, no property map."""
    conv = ad.conversations(spark, sf)
    entries = F.map_filter("properties", lambda k, v: k.isin("channel_id", "support_area"))
    return (conv.withColumn("tags", F.try_element_at("properties", F.lit("tags")))
            .withColumn("context", F.col("context").withField("environment", entries))
            .withColumn("properties", F.when(F.expr("conv_id % 3 = 0"), F.col("properties"))))


@query(f"""WITH {CONV_SQL} SELECT conv_id, coalesce(support_area, CASE WHEN conv_id % 50 < 40
  THEN concat('area', conv_id % 50) END) AS support_area FROM conv""")
def backfill_property(spark, sf):
    areas = ad.table(spark, sf, "conversations").select(F.expr("conv_id % 50").alias("_c")).distinct().filter(
        "_c < 40").select(F.concat(F.lit("c"), "_c").alias("channel_id"), F.concat(F.lit("area"), "_c").alias(
            "support_area"))
    filled = m.backfill_property(_legacy(spark, sf), areas)
    return filled.select("conv_id", F.get(F.try_element_at(
        "context.environment", F.lit("support_area")), F.lit(0)).alias("support_area"))


@query(f"""WITH {CONV_SQL}, c AS (SELECT DISTINCT domain FROM conv WHERE conv_id % 2 = 1),
x AS (SELECT domain AS name, substr(sha256(domain), 1, 24) AS client FROM c)
SELECT 'conversations' AS part, CAST(conv_id AS VARCHAR) AS key,
  CASE WHEN conv_id % 2 = 1 THEN x.client ELSE owner END AS value FROM conv LEFT JOIN x ON x.name = domain
UNION ALL SELECT 'clients', name, client FROM x UNION ALL SELECT 'settings', client, 'default' FROM x""")
def derive_clients(spark, sf):
    conv = ad.conversations(spark, sf).withColumn("owner", F.expr("case when conv_id % 2 = 0 then owner end"))
    clients = conv.limit(0).select(F.col("owner").alias("client"), F.col("owner").alias("name"), F.lit(False).alias(
        "default_client"), F.col("last_modified").alias("last_update"))
    settings = conv.limit(0).select(F.col("owner").alias("client"), F.lit("x").alias("config"),
                                    F.col("last_modified").alias("modified"))
    owned, created, configured = m.derive_clients(conv, clients, settings, F.lit("default"), _now())
    return _tagged(
        conversations=owned.select(F.col("conv_id").cast("string").alias("key"), F.col("owner").alias("value")),
        clients=created.select(F.col("name").alias("key"), F.col("client").alias("value")),
        settings=configured.select(F.col("client").alias("key"), F.col("config").alias("value")))


@query(f"""WITH {CONV_SQL} SELECT conv_id, concat_ws(';', concat('channel_id=', channel_id),
  CASE WHEN support_area IS NOT NULL THEN concat('support_area=', support_area) END,
  concat('tags=', array_to_string(tags, ',')), CASE WHEN conv_id % 3 = 0 THEN 'token=secret' END) AS properties
FROM conv""")
def restructure_meta(spark, sf):
    moved = m.restructure_meta(_legacy(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("properties")),
                          lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return moved.select("conv_id", F.array_join(entries, ";").alias("properties"))


@query("""SELECT page_id, url AS plain, CASE WHEN page_id % 2 = 0 THEN concat(url, ' ä+b') ELSE '%zz' END AS decoded
FROM pages""")
def decode_defaults(spark, sf):
    pages = ad.table(spark, sf, "pages")
    values = F.create_map(F.lit("plain"), F.col("url"), F.lit("coded"), F.when(
        F.expr("page_id % 2 = 0"), F.replace(F.url_encode(F.concat("url", F.lit(" ä+b"))), F.lit("+"), F.lit("%20")))
        .otherwise("%zz"))
    decoded = pages.select("page_id", m.decode_defaults(values).alias("v"))
    return decoded.select("page_id", F.col("v.plain").alias("plain"), F.col("v.coded").alias("decoded"))


@query(f"WITH {CONV_SQL} SELECT conv_id, owner FROM conv")
def drop_legacy_columns(spark, sf):
    conv = ad.conversations(spark, sf).select("conv_id", "owner", F.lit("x").alias("channelId"),
                                              F.lit("y").alias("tokens"))
    return m.drop_legacy_columns(conv)


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'search:true' WHEN 1 THEN 'search:true,chat:false'
  ELSE concat('related:', n_nationkey % 2 = 0, ',chat:', n_nationkey % 2 = 0) END AS components FROM nation""")
def add_component_if_absent(spark, sf):
    nation = ad.table(spark, sf, "nation")

    def component(kind, enabled):
        return f"named_struct('type', '{kind}', 'name', '{kind}', 'enabled', {enabled})"

    components = F.expr(f"""case n_regionkey when 0 then array({component('search', 'true')})
        when 1 then array({component('search', 'true')}, {component('chat', 'false')})
        else array({component('related', 'n_nationkey % 2 = 0')}) end""")
    out = nation.select("n_nationkey", m.add_component_if_absent(components, "related", "chat").alias("c"))
    return out.select("n_nationkey", F.array_join(F.transform(
        "c", lambda c: F.concat(c["type"], F.lit(":"), c["enabled"].cast("string"))), ",").alias("components"))


@query(f"""WITH {CONV_SQL}, n AS (SELECT conv_id + CASE WHEN conv_id % 5 = 0 THEN 1000000 ELSE 0 END AS conv_id,
    CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN owner WHEN 2 THEN 'changed' ELSE owner END AS owner, deleted FROM conv),
k AS (SELECT n.*, c.owner AS stored, c.conv_id IS NOT NULL AS known,
  CASE WHEN n.deleted IS NOT NULL THEN 'marked as deleted' WHEN c.conv_id IS NULL AND n.owner IS NULL THEN 'owner missing'
    WHEN c.conv_id IS NOT NULL AND n.owner IS NOT NULL AND n.owner <> c.owner THEN 'owner must not change' END AS reason
  FROM n LEFT JOIN conv c ON c.conv_id = n.conv_id)
SELECT 'stored' AS part, conv_id, coalesce(owner, stored) AS label, true AS fresh FROM k WHERE reason IS NULL
UNION ALL SELECT 'stored', conv_id, owner, false FROM conv WHERE conv_id NOT IN (SELECT conv_id FROM k WHERE reason IS NULL)
UNION ALL SELECT 'rejected', conv_id, reason, NULL FROM k WHERE reason IS NOT NULL""")
def store_conversations(spark, sf):
    conv = ad.conversations(spark, sf)
    new = conv.withColumn("owner", F.expr(
        "case conv_id % 4 when 0 then null when 2 then 'changed' else owner end")).withColumn(
        "conv_id", F.expr("conv_id + case when conv_id % 5 = 0 then 1000000 else 0 end"))
    stored, rejected = m.store_conversations(conv, new, _now())
    return _tagged(
        stored=stored.select("conv_id", F.col("owner").alias("label"), (F.col("last_modified") == _now()).alias("fresh")),
        rejected=rejected.select("conv_id", F.col("reason").alias("label"),
                                 F.lit(None).cast("boolean").alias("fresh")))


@query("""WITH stored AS (SELECT concat('k', r_regionkey) AS client, lower(r_name) AS name, r_regionkey = 0 AS d
  FROM region),
new AS (SELECT concat('n', n_nationkey) AS client, CASE WHEN n_nationkey % 4 = 3 THEN 'africa'
    WHEN n_nationkey % 4 = 2 THEN n_name ELSE lower(replace(n_name, ' ', '-')) END AS name, n_nationkey FROM nation),
k AS (SELECT *, CASE WHEN NOT regexp_full_match(name, '[a-z0-9_\\.:-]+') THEN 'name does not match'
  WHEN name IN (SELECT name FROM stored) THEN 'name is taken'
  WHEN row_number() OVER (PARTITION BY name ORDER BY n_nationkey) > 1 THEN 'name is taken' END AS reason FROM new),
top AS (SELECT max_by(client, n_nationkey) AS client FROM k WHERE reason IS NULL AND n_nationkey % 2 = 0)
SELECT 'clients' AS part, s.client, name, CASE WHEN top.client IS NULL THEN d ELSE s.client = top.client END AS flag
  FROM stored s, top
UNION ALL SELECT 'clients', k.client, name, CASE WHEN top.client IS NULL THEN false ELSE k.client = top.client END
  FROM k, top WHERE reason IS NULL
UNION ALL SELECT 'rejected', client, reason, NULL FROM k WHERE reason IS NOT NULL
UNION ALL SELECT 'settings', client, concat('conf-', client), NULL FROM stored
UNION ALL SELECT 'settings', client, 'conf-k0', NULL FROM k WHERE reason IS NULL""")
def upsert_clients(spark, sf):
    region, nation = ad.table(spark, sf, "region"), ad.table(spark, sf, "nation")
    clients = region.select(F.concat(F.lit("k"), "r_regionkey").alias("client"), F.lower("r_name").alias("name"),
                            (F.col("r_regionkey") == 0).alias("default_client"), _now().alias("last_update"))
    name = F.expr("case when n_nationkey % 4 = 3 then 'africa' when n_nationkey % 4 = 2 then n_name "
                  "else lower(replace(n_name, ' ', '-')) end")
    new = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("client"), name.alias("name"),
                        F.expr("n_nationkey % 2 = 0").alias("default_client"), F.col("n_nationkey").alias("seq"))
    settings = clients.select("client", F.concat(F.lit("conf-"), "client").alias("config"))
    merged, configured, rejected = m.upsert_clients(clients, new, settings, _now())
    return _tagged(settings=configured.select("client", F.col("config").alias("name"),
                                              F.lit(None).cast("boolean").alias("flag")), clients=merged.select("client", "name", F.col("default_client").alias("flag")),
                   rejected=rejected.select("client", F.col("reason").alias("name"),
                                            F.lit(None).cast("boolean").alias("flag")))


@query("""WITH s AS (SELECT n_nationkey AS position, concat('c', n_regionkey) AS client, 'queryBuilder' AS category,
    concat('t', n_nationkey % 3) AS type, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat('n', n_nationkey % 5) END AS name,
    CASE WHEN n_nationkey % 8 = 0 THEN ' ' WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('É ', n_name) END AS display_name
  FROM nation),
c AS (SELECT * EXCLUDE (name, display_name), CASE WHEN trim(display_name) = '' THEN name WHEN trim(name) = ''
    THEN lower(regexp_replace(strip_accents(replace(display_name, ' ', '-')), '[^A-Za-z0-9_-]', '', 'g')) ELSE name END AS name,
    CASE WHEN trim(display_name) = '' THEN name ELSE display_name END AS display_name FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY client, type, name ORDER BY position) AS n FROM c)
SELECT 'valid' AS part, position, name, display_name, type = 't2' AS unbound FROM k WHERE trim(name) <> '' AND n = 1
UNION ALL SELECT 'conflict', position, CASE WHEN trim(name) = '' THEN 'displayName' ELSE 'name' END, NULL, NULL
FROM k WHERE trim(name) = '' OR n > 1""")
def validate_settings(spark, sf):
    settings = ad.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("position"), F.concat(F.lit("c"), "n_regionkey").alias("client"),
        F.lit("queryBuilder").alias("category"), F.expr("concat('t', n_nationkey % 3)").alias("type"),
        F.expr("case when n_nationkey % 4 = 0 then '' else concat('n', n_nationkey % 5) end").alias("name"),
        F.expr("case when n_nationkey % 8 = 0 then ' ' when n_nationkey % 3 = 0 then '' else concat('É ', n_name) end")
        .alias("display_name"))
    valid, conflicts = m.validate_settings(settings, ["t0", "t1"])
    none = F.lit(None)
    return _tagged(valid=valid.select("position", "name", "display_name", "unbound"),
                   conflict=conflicts.select("position", F.col("field").alias("name"), none.cast("string").alias(
                       "display_name"), none.cast("boolean").alias("unbound")))
