"""Readers and writers over tables derived from the driver's."""

import uuid

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, MSG_SQL
from parley.operators import search as s
from parley.plans.registry import query
from parley.plans.retrieval import _CORPUS_SQL, _IT_SQL
from parley.session import shared_dir
from parley.sources import index, readers, writers


def scratch(spark, name):
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {MSG_SQL}, {CONV_SQL} SELECT 'conversation' AS part, conv_id, status AS label, channel_id AS value,
  modified AS t FROM conv WHERE deleted IS NULL AND owner = 'o1'
UNION ALL SELECT 'message', conv_id, msg_id, md5(content), t FROM msg JOIN (SELECT conv_id, owner, deleted FROM conv)
  USING (conv_id) WHERE deleted IS NULL AND owner = 'o1'""")
def export_and_read_conversations(spark, sf):
    path = scratch(spark, "export")
    writers.export_conversations(ad.conversations(spark, sf), ad.messages(spark, sf), "o1", path)
    conv, msg = readers.read_conversations(spark, path, "o1", json_array=False)
    return conv.select(
        F.lit("conversation").alias("part"), F.col("conv_id").cast("long").alias("conv_id"), F.col("status").alias("label"),
        F.get(F.try_element_at("properties", F.lit("channel_id")), F.lit(0)).alias("value"),
        F.unix_millis("last_modified").alias("t")).unionByName(msg.select(
            F.lit("message").alias("part"), F.col("conv_id").cast("long").alias("conv_id"), F.col("msg_id").alias("label"),
            F.md5("content").alias("value"), F.unix_millis("time").alias("t")))


@query(f"""WITH {MSG_SQL}, {CONV_SQL}, m AS (SELECT * FROM msg WHERE user_id IS NOT NULL AND conv_id % 5 <> 0),
d AS (SELECT conv_id, min_by(t, idx) AS date FROM msg GROUP BY conv_id)
SELECT c.conv_id AS "ID", status AS "Status", c.user_id AS "User", channel_id AS "Channel", domain AS "Domain",
  date AS "Date", m.idx AS "Msg Idx", m.msg_id AS "Msg Id", m.user_id AS "Sender", m.t AS "Sent", content AS "Content"
FROM conv c JOIN d USING (conv_id) LEFT JOIN m USING (conv_id) WHERE status = 'Complete'""")
def conversations_to_flat(spark, sf):
    msg = ad.messages(spark, sf)
    msg = msg.withColumn("user_id", F.when(F.expr("conv_id % 5 <> 0"), F.col("user_id")))
    flat = writers.conversations_to_flat(ad.conversations(spark, sf), msg)
    return flat.withColumn("Date", F.unix_millis("Date")).withColumn("Sent", F.unix_millis("Sent"))


@query(f"""WITH {MSG_SQL}, {CONV_SQL} SELECT "ID", "Status", "Msg Idx", "Content" FROM (SELECT CAST(conv_id AS VARCHAR)
  AS "ID", status AS "Status", CAST(m.idx AS VARCHAR) AS "Msg Idx", trim(concat('x ', replace(content, chr(10), ' ')))
  AS "Content" FROM conv JOIN msg m USING (conv_id) WHERE m.user_id IS NOT NULL)""")
def write_flat(spark, sf):
    path = scratch(spark, "flat")
    msg = ad.messages(spark, sf).withColumn("content", F.concat(F.lit("  x "), F.replace(
        "content", F.lit("\n"), F.lit(" ")), F.lit(" "))).filter("user_id is not null")
    conv = ad.conversations(spark, sf).join(msg.select("conv_id"), "conv_id", "left_semi")
    writers.write_flat(writers.conversations_to_flat(conv, msg, include_open=True), path)
    return spark.read.option("header", True).csv(path).select("ID", "Status", "Msg Idx", "Content")


@query("""WITH l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS line FROM part
  WHERE p_partkey % 11 <> 0)
SELECT CAST(NULL AS VARCHAR) AS lang, lower(line) AS key, array_to_string(list_sort(list_distinct(list(line))), '|')
  AS variants FROM l GROUP BY lower(line)""")
def read_stopwords(spark, sf):
    path = scratch(spark, "stopwords")
    line = F.expr("case when p_partkey % 11 = 0 then concat('# ', p_name) when p_partkey % 3 = 0 then upper(p_name) "
                  "else concat('  ', p_name, ' ') end")
    ad.table(spark, sf, "part").select(line.alias("value")).union(spark.sql("select '' as value")).write.text(path)
    return readers.read_stopwords(spark, path).withColumn("variants", F.array_join("variants", "|"))


@query("""SELECT 'en' AS lang, word AS key, word AS variants FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word
  FROM part)""")
def read_snowball_stopwords(spark, sf):
    path = scratch(spark, "snowball")
    ad.table(spark, sf, "part").select(F.concat("p_name", F.lit("   | "), "p_brand").alias("value")).union(
        spark.sql("select ' | only a comment' as value")).write.text(path)
    return readers.read_snowball_stopwords(spark, path, "en").withColumn("variants", F.array_join("variants", "|"))


@query("""SELECT DISTINCT p_brand AS label, unnest([p_brand, p_name, p_type]) AS surface, 'parts' AS tag,
  CAST(NULL AS VARCHAR) AS lang FROM part""")
def read_vocabulary(spark, sf):
    path = scratch(spark, "vocabulary")
    ad.table(spark, sf, "part").select(F.concat_ws("; ", "p_brand", "p_name", "p_type", F.lit("")).alias("value")).write.text(
        path)
    return readers.read_vocabulary(spark, path, ";", "parts")


@query("""SELECT 'doc' AS part, lang AS client, concat('d', doc_id) AS id, source AS value FROM documents WHERE doc_id % 4 < 2
UNION ALL SELECT 'doc', lang, concat('e', doc_id), NULL FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT 'rejected', lang, CAST(doc_id AS VARCHAR), NULL FROM documents WHERE doc_id % 4 >= 2""")
def ingest_chat_docs(spark, sf):
    single = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("text")))
    second = F.to_json(F.struct(F.concat(F.lit("e"), "doc_id").alias("id")))
    shape = F.expr("doc_id % 4")
    json = F.when(shape == 0, single).when(shape == 1, F.concat(F.lit(" ["), single, F.lit(","), second, F.lit("]"))).when(
        shape == 2, F.lit('"text"')).otherwise(F.lit('[{"x": "no id"}]'))
    raw = ad.documents(spark, sf).select(F.col("doc_id").alias("seq"), "lang", json.alias("json"))
    docs, rejected = readers.ingest_chat_docs(raw.withColumn("client", F.col("lang")), F.col("lang"))
    return docs.select(F.lit("doc").alias("part"), "client", "id", F.col("data")["text"].alias("value")).unionByName(
        rejected.select(F.lit("rejected").alias("part"), F.col("lang").alias("client"), F.col("seq").cast("string").alias(
            "id"), F.lit(None).cast("string").alias("value")))


@query(f"WITH {_CORPUS_SQL} SELECT 'documents' AS corpus, term, df, n FROM cdf, cn")
def register_corpus(spark, sf):
    name, stats, size = readers.register_corpus("documents", ad.documents(spark, sf), ["doc_id"], "text")
    return stats.select(F.lit(name).alias("corpus"), "term", "df", size.alias("n"))


@query(f"""WITH {MSG_SQL} SELECT conv_id, idx, CASE WHEN conv_id % 3 = 1 THEN concat('new ', msg_id) ELSE msg_id END AS label
FROM msg WHERE conv_id % 4 <> 2 AND NOT (conv_id % 3 = 1 AND idx > 2)""")
def write_search_docs(spark, sf):
    """Write, replace a third of the conversations, delete a quarter, and read what is left."""
    path = scratch(spark, "docs")
    docs = ad.messages(spark, sf).select("conv_id", "idx", F.col("msg_id").alias("label"))
    index.write_search_docs(docs, path, buckets=8)
    changed = docs.filter("conv_id % 3 = 1 and idx <= 2").withColumn("label", F.concat(F.lit("new "), "label"))
    index.write_search_docs(changed, path, buckets=8)
    index.delete_search_docs(spark, path, docs.filter("conv_id % 4 = 2").select("conv_id").distinct(), buckets=8)
    return index.read_search_docs(spark, path)


# Of every third conversation the first three messages are left, with a word more; every fourth is gone.
_CHANGED_SQL = f"""{MSG_SQL}, {CONV_SQL},
now AS (SELECT conv_id, idx, owner, CASE WHEN conv_id % 3 = 1 THEN concat(content, ' again') ELSE content END AS content
  FROM msg JOIN conv USING (conv_id) WHERE conv_id % 4 <> 2 AND NOT (conv_id % 3 = 1 AND idx > 2)),
nw AS (SELECT *, list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM now),
nt AS (SELECT conv_id, idx, owner, len(ws) AS len, lower(unnest(ws)) AS term FROM nw),
ntf AS (SELECT conv_id, idx, owner, term, any_value(len) AS len, count(*) AS tf FROM nt GROUP BY conv_id, idx, owner, term)"""


def _changed_index(spark, sf):
    """An index after three batches: all messages, the changed conversations, the removed ones (these twice)."""
    path, shape = scratch(spark, "deltas"), index.Shape(buckets=4)
    conv = ad.conversations(spark, sf).select("conv_id", "owner")
    docs = ad.stored(ad.messages(spark, sf).select("conv_id", "idx", "content").join(conv, "conv_id"))
    index.write_batch(docs, path, shape)
    index.write_batch(docs.filter("conv_id % 3 = 1 and idx <= 2").withColumn("content", F.concat(
        "content", F.lit(" again"))), path, shape)
    for _ in range(2):
        index.write_batch(None, path, shape, docs.filter("conv_id % 4 = 2").select("conv_id"), spark)
    return index.Index(spark, path, shape)


@query(f"""WITH {_CHANGED_SQL} SELECT owner, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS words
FROM ntf GROUP BY owner, term
UNION ALL SELECT owner, NULL, count(*), NULL, CAST(sum(len(ws)) AS BIGINT) FROM nw GROUP BY owner""")
def index_frequencies_after_changes(spark, sf):
    """Document frequencies and sizes are sums of the signed changes of all batches."""
    found = _changed_index(spark, sf)
    none = F.lit(None).cast("bigint")
    sizes = found.sizes().select("owner", F.lit(None).cast("string").alias("term"), F.col("n").alias("df"),
                                 none.alias("total"), "words")
    return found.frequencies().select("owner", "term", "df", "total", none.alias("words")).unionByName(sizes)


@query(f"WITH {_CHANGED_SQL} SELECT conv_id, idx, owner, term, tf, len FROM ntf")
def index_postings_after_changes(spark, sf):
    return _changed_index(spark, sf).postings()


@query(f"""WITH {CONV_SQL}, {MSG_SQL} SELECT 'c' AS part, owner, CAST(count(*) AS BIGINT) AS n FROM conv
WHERE owner <> 'o1' OR conv_id % 2 = 0 GROUP BY owner
UNION ALL SELECT 'm', owner, count(*) FROM msg JOIN conv USING (conv_id)
WHERE CASE WHEN owner = 'o1' THEN conv_id % 2 = 0 ELSE conv_id % 3 <> 0 OR idx <= 2 END GROUP BY owner""")
def store_imported(spark, sf):
    """Import everything, a third of the others' conversations again with fewer messages, and replace owner o1."""
    path = scratch(spark, "import")
    conv, msg = ad.conversations(spark, sf).drop("user"), ad.messages(spark, sf)
    writers.store_imported(conv, msg, path)
    again = conv.filter("owner <> 'o1' and conv_id % 3 = 0")
    writers.store_imported(again, msg.filter("idx <= 2"), path)
    writers.store_imported(conv.filter("owner = 'o1' and conv_id % 2 = 0"), msg, path, replace=True)
    stored_conv, stored_msg = (spark.read.parquet(f"{path}/{name}") for name in ("conversations", "messages"))
    count = F.count(F.lit(1)).alias("n")
    return stored_conv.groupBy("owner").agg(count).select(F.lit("c").alias("part"), "owner", "n").unionByName(
        stored_msg.groupBy("owner").agg(count).select(F.lit("m").alias("part"), "owner", "n"))


@query(f"""WITH {_CORPUS_SQL}, {_IT_SQL.format(key='doc_id', tf='ctf', df='cdf', on='term', n=', cn')}
SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, weight FROM it WHERE rank <= 20""")
def interesting_terms_of_a_stored_corpus(spark, sf):
    """The texts are read once, when the corpus is stored."""
    path = scratch(spark, "corpus")
    shape = writers.write_corpus(ad.documents(spark, sf), path, ["doc_id"], "text")
    tf, stats, sizes = writers.read_corpus(spark, path, shape)
    best = s.interesting_terms(tf.drop("len"), stats.drop("total"), sizes.select("n").scalar(), ["doc_id"])
    return best.select("doc_id", "term", "rank", "weight")
