"""Search and similarity queries."""

import uuid

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, MSG_SQL
from parley.functions import stemming as st
from parley.functions import text as tx
from parley.operators import filters as f
from parley.operators import indexed as ix
from parley.operators import search as s
from parley.operators import windows as w
from parley.plans.registry import query
from parley.plans.sequences import _RUNS_SQL, _START_SQL
from parley.scan import bucket_of, spread_join
from parley.session import shared_dir, written
from parley.sources.index import Index, Shape, write_batch

# Search texts per tenant; the tables they run over are the whole ones.
SEARCHES = [("q1", "o0", "chkeit ung-erlich 42"), ("q2", "o1", "Étion le"), ("q3", "o2", "thtion that"),
            ("q4", "o0", "en"), ("q5", "o2", "xyzxyz ???")]
_SEARCHES_SQL = "q(query_id, owner, text) AS (VALUES " + ", ".join(
    f"('{i}', '{o}', '{t}')" for i, o, t in SEARCHES) + ")"

_DOCS_SQL = f"""{MSG_SQL}, {CONV_SQL}, {_RUNS_SQL.format(now='t', limit=30000)},
docs AS (SELECT r.conv_id, min(r.idx) AS idx, any_value(c.owner) AS owner,
    any_value(c.status) = 'Complete' AS completed, any_value(c.support_area) AS support_area,
    string_agg(content, chr(10) ORDER BY r.idx) AS content, min_by(t, r.idx) AS t,
    list(r.idx ORDER BY r.idx) AS idxs, CAST(sum(votes) AS BIGINT) AS votes
  FROM runs r JOIN conv c USING (conv_id) WHERE c.deleted IS NULL GROUP BY r.conv_id, r.run),
words AS (SELECT *, list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM docs),
terms AS (SELECT conv_id, idx, owner, len(ws) AS len, lower(unnest(ws)) AS term FROM words),
tf AS (SELECT conv_id, idx, owner, term, count(*) AS tf, any_value(len) AS len FROM terms GROUP BY ALL EXCEPT (len))"""
_DOCS_SQL = _DOCS_SQL.replace("GROUP BY ALL EXCEPT (len)", "GROUP BY conv_id, idx, owner, term")

_HITS_SQL = f"""WITH {_DOCS_SQL}, {_SEARCHES_SQL},
toks AS (SELECT query_id, owner, unnest(regexp_split_to_array(text, '\\s+')) AS tok FROM q),
clauses AS (SELECT DISTINCT query_id, owner, lower(tok) AS clause, mode, boost FROM (
  SELECT *, 'exact' AS mode, 4 AS boost FROM toks WHERE regexp_matches(tok, '[\\p{{L}}\\p{{Nd}}]')
  UNION ALL SELECT *, 'prefix', 2 FROM toks WHERE regexp_matches(tok, '[\\p{{L}}\\p{{Nd}}]$')
    AND NOT regexp_matches(tok, '^\\p{{Nd}}+$')
  UNION ALL SELECT *, 'infix', 1 FROM toks WHERE regexp_matches(tok, '^[\\p{{L}}\\p{{Nd}}]+$')
    AND NOT regexp_matches(tok, '^\\p{{Nd}}+$'))),
found AS (SELECT query_id, owner, conv_id, idx, clause, mode, any_value(boost) AS boost, sum(tf) AS tf,
    any_value(len) AS len
  FROM clauses c JOIN tf USING (owner)
  WHERE CASE mode WHEN 'exact' THEN term = clause WHEN 'prefix' THEN starts_with(term, clause)
    ELSE contains(term, clause) END
  GROUP BY query_id, owner, conv_id, idx, clause, mode),
freq AS (SELECT term AS clause, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM words),
hits AS (SELECT query_id, owner, conv_id, idx, round(sum(CASE WHEN mode = 'exact' THEN
    boost * (1 + ln((n + 1) / (df + 1))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))
    ELSE boost END), 6) AS score
  FROM found LEFT JOIN freq USING (clause), size GROUP BY query_id, owner, conv_id, idx)"""


def _docs(spark, sf):
    conv = ad.conversations(spark, sf).filter("deleted is null").select(
        "conv_id", "owner", (F.col("status") == "Complete").alias("completed"),
        F.try_element_at("properties", F.lit("support_area")).alias("support_area"))
    merged = w.merge_consecutive(ad.messages(spark, sf))
    return spread_join(merged.withColumn("_bucket", bucket_of("idx")), conv, ["conv_id"], "_bucket").drop("_bucket")


def _searches(spark):
    return spark.createDataFrame(SEARCHES, "query_id string, owner string, text string")


SHAPE = Shape(buckets=16)
_INDEXES: dict[tuple[str, str], Index] = {}


def _index(spark, sf):
    """The index of merged messages; written once in a session, then searched by many queries."""
    named = (spark.sparkContext.applicationId, sf)
    if named not in _INDEXES:
        path = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
        write_batch(_docs(spark, sf).select("conv_id", "idx", "owner", "content", "message_idxs"), path, SHAPE)
        _INDEXES[named] = Index(spark, path, SHAPE)
    return _INDEXES[named]


def _search(spark, sf):
    index = _index(spark, sf)
    return index.docs(), ix.search(index, _searches(spark))


@query(f"{_HITS_SQL} SELECT query_id, conv_id, idx, score FROM hits")
def search_messages(spark, sf):
    _, hits = _search(spark, sf)
    return hits.select("query_id", "conv_id", "idx", "score")


@query(f"""{_HITS_SQL} SELECT query_id, conv_id, idx, rank, num_found FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, conv_id, idx) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id)
  AS num_found FROM hits) WHERE rank > 5 AND rank <= 10""")
def search_messages_page(spark, sf):
    """The second page of five, with the number of all hits."""
    _, hits = _search(spark, sf)
    page, found = s.paged_hits(hits, [F.desc("score"), F.col("conv_id"), F.col("idx")], 1, 5)
    return page.join(found, "query_id").select("query_id", "conv_id", "idx", "rank", "num_found")


_GROUPED_SQL = """, best AS (SELECT query_id, conv_id, max(score) AS best FROM hits GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, conv_id) AS group_rank,
  count(*) OVER (PARTITION BY query_id) AS num_found FROM best),
few AS (SELECT * FROM (SELECT h.*, group_rank, num_found,
    row_number() OVER (PARTITION BY h.query_id, h.conv_id ORDER BY score DESC, h.idx) AS r
  FROM hits h JOIN top USING (query_id, conv_id) WHERE group_rank <= 10) WHERE r <= 3)"""


@query(f"{_HITS_SQL}{_GROUPED_SQL} SELECT query_id, conv_id, idx, score, group_rank, num_found FROM few")
def group_hits(spark, sf):
    _, hits = _search(spark, sf)
    return s.group_hits(hits, per_group=3).select("query_id", "conv_id", "idx", "score", "group_rank", "num_found")


@query(f"{_HITS_SQL}{_GROUPED_SQL} SELECT query_id, conv_id, idx, score, CAST(group_rank AS INTEGER) AS group_rank FROM few")
def top_groups(spark, sf):
    """The same groups without their total number: blocks of documents that cannot reach them are not scored."""
    found = ix.top_groups(_index(spark, sf), _searches(spark), 10, 3)
    return found.select("query_id", "conv_id", "idx", "score", "group_rank")


@query(f"""{_HITS_SQL}{_GROUPED_SQL},
hit_msgs AS (SELECT query_id, k.conv_id, group_rank, num_found, unnest(idxs) AS idx, score
  FROM few k JOIN docs d ON d.conv_id = k.conv_id AND d.idx = k.idx),
islands AS (SELECT *, idx - row_number() OVER (PARTITION BY query_id, conv_id ORDER BY idx) AS g FROM hit_msgs),
found_runs AS (SELECT query_id, conv_id, any_value(group_rank) AS group_rank, any_value(num_found) AS num_found,
  min(idx) AS start, max(idx) + 1 AS "end", min_by(score, idx) AS score FROM islands GROUP BY query_id, conv_id, g)
SELECT query_id, conv_id, group_rank, num_found, start, "end", score,
  (SELECT string_agg(m.idx, ',' ORDER BY m.idx) FROM msg m WHERE m.conv_id = r.conv_id
    AND m.idx >= start - 1 AND m.idx < start) AS before,
  (SELECT string_agg(m.idx, ',' ORDER BY m.idx) FROM msg m WHERE m.conv_id = r.conv_id
    AND m.idx >= "end" AND m.idx < "end" + 2) AS after
FROM found_runs r""")
def search_conversations(spark, sf):
    docs, hits = _search(spark, sf)
    kept = s.group_hits(hits, per_group=3)
    hit_msgs = s.hits_to_messages(kept, docs).select("query_id", "conv_id", "group_rank", "num_found", "idx", "score")
    found = w.runs_with_neighbours(w.hit_runs(hit_msgs), ad.messages(spark, sf))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda i: i.cast("string")), ","))
    return found.select("query_id", "conv_id", "group_rank", "num_found", "start", "end", "score",
                        *[listed(c).alias(c) for c in ("before", "after")])


@query(f"""WITH {_DOCS_SQL}, {_SEARCHES_SQL},
toks AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '\\s+'))) AS clause FROM q),
vocab AS (SELECT DISTINCT term FROM tf)
SELECT clause, term, CASE WHEN term = clause THEN 7 WHEN starts_with(term, clause) THEN 3 ELSE 1 END AS boost
FROM toks JOIN vocab ON contains(term, clause)
WHERE regexp_matches(clause, '^[\\p{{L}}\\p{{Nd}}]+$') AND NOT regexp_matches(clause, '^\\p{{Nd}}+$')""")
def wildcard_match(spark, sf):
    clauses = s.query_clauses(_searches(spark).select("text")).filter(~F.col("clause").rlike(r"^\p{Nd}+$"))
    found = ix.wildcard_match(_index(spark, sf), clauses)
    return found.groupBy("clause", "term").agg(F.sum("boost").cast("int").alias("boost"))


@query(f"WITH {_DOCS_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term")
def term_stats(spark, sf):
    return _index(spark, sf).frequencies().groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


_CORPUS_SQL = """ct AS (SELECT doc_id, lower(unnest(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'),
  lambda x: x <> ''))) AS term FROM documents),
ctf AS (SELECT doc_id, term, count(*) AS tf FROM ct GROUP BY ALL),
cdf AS (SELECT term, count(*) AS df FROM ctf GROUP BY term), cn AS (SELECT count(*) AS n FROM documents)"""


@query(f"WITH {_CORPUS_SQL} SELECT doc_id, term, tf FROM ctf")
def postings(spark, sf):
    return s.postings(ad.documents(spark, sf), ["doc_id"], "text").select("doc_id", "term", "tf")


@query(f"WITH {_CORPUS_SQL} SELECT term, df FROM cdf")
def corpus_term_stats(spark, sf):
    return s.document_frequencies(ad.documents(spark, sf), "text")


_IT_SQL = """it AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY weight DESC, term) AS rank FROM (
  SELECT {key}, term, tf, round(tf * (1 + ln((n + 1) / (df + 1))), 6) AS weight
  FROM {tf} JOIN {df} USING ({on}) {n} WHERE length(term) >= 3))"""


@query(f"""WITH {_CORPUS_SQL}, {_IT_SQL.format(key='doc_id', tf='ctf', df='cdf', on='term', n=', cn')}
SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, weight,
  round(weight / max(weight) OVER (PARTITION BY doc_id), 6) AS boost FROM it WHERE rank <= 20""")
def interesting_terms(spark, sf):
    docs = ad.documents(spark, sf)
    tf = s.postings(docs, ["doc_id"], "text").drop("len")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = ad.stored(s.document_frequencies(docs, "text"))
    best = s.interesting_terms(tf, stats, n_docs, ["doc_id"])
    return best.select("doc_id", "term", "rank", "weight", F.round("boost", 6).alias("boost"))


# Terms of whole conversations (messages not skipped) within a tenant.
_CONV_TERMS_SQL = f"""{MSG_SQL}, {CONV_SQL},
kt AS (SELECT conv_id, owner, lower(unnest(list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> ''))) AS term FROM msg JOIN conv USING (conv_id) WHERE NOT skip AND NOT private
    AND deleted IS NULL),
ktf AS (SELECT conv_id, owner, term, count(*) AS tf FROM kt GROUP BY ALL),
kdf AS (SELECT owner, term, count(*) AS df FROM ktf GROUP BY ALL),
kn AS (SELECT owner, count(*) AS n FROM conv WHERE deleted IS NULL GROUP BY owner),
kdfn AS (SELECT * FROM kdf JOIN kn USING (owner)),
{_IT_SQL.format(key='owner, conv_id', tf='ktf', df='kdfn', on='owner, term', n='')}"""


# The terms asked are those of the context of the last message, the frequencies those of whole conversations.
_CONTEXT_TERMS_SQL = f"""{MSG_SQL}, {CONV_SQL}{_START_SQL},
kt AS (SELECT conv_id, idx, owner, lower(unnest(list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> ''))) AS term FROM msg JOIN conv USING (conv_id) WHERE NOT skip AND NOT private
    AND deleted IS NULL),
kdf AS (SELECT owner, term, count(DISTINCT conv_id) AS df FROM kt GROUP BY ALL),
kn AS (SELECT owner, count(*) AS n FROM conv WHERE deleted IS NULL GROUP BY owner),
kdfn AS (SELECT * FROM kdf JOIN kn USING (owner)),
ktf AS (SELECT kt.conv_id, owner, term, count(*) AS tf FROM kt JOIN starts USING (conv_id) WHERE idx >= start GROUP BY ALL),
{_IT_SQL.format(key='owner, conv_id', tf='ktf', df='kdfn', on='owner, term', n='')}"""


def _context_terms(spark, sf):
    """Term counts of each conversation's context, and the statistics of whole conversations."""
    _, stats = _conversation_terms(spark, sf)
    conv = ad.conversations(spark, sf).filter("deleted is null").select("conv_id", "owner")
    msg = ad.messages(spark, sf)
    inside = w.indexable_messages(f.in_context(msg, w.context_start(msg))).select("conv_id", "content")
    tf = s.doc_terms(inside).drop("len").groupBy("conv_id", "term").agg(F.sum("tf").alias("tf"))
    return ad.stored(tf.join(conv, "conv_id")), stats


def _conversation_terms(spark, sf):
    conv = ad.conversations(spark, sf).filter("deleted is null").select("conv_id", "owner")
    msg = w.indexable_messages(ad.messages(spark, sf)).select("conv_id", "content")
    per_message = s.doc_terms(msg).drop("len").groupBy("conv_id", "term").agg(F.sum("tf").alias("tf"))
    tf = ad.stored(per_message.join(conv, "conv_id"))
    sizes = conv.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return tf, s.term_stats(tf, ["owner"]).join(sizes, "owner")


def _conversation_interests(spark, sf, max_terms=10):
    tf, stats = _conversation_terms(spark, sf)
    return s.interesting_terms(tf, stats, F.col("n"), ["owner", "conv_id"], ["owner"], max_terms)


@query(f"""WITH {_CONTEXT_TERMS_SQL}, b AS (SELECT *, weight / max(weight) OVER (PARTITION BY conv_id) AS boost
  FROM it WHERE rank <= 10)
SELECT conv_id, string_agg(CASE WHEN rank = 1 THEN term ELSE concat(term, '^', printf('%.4f', boost)) END, ' OR '
  ORDER BY rank) AS similarity_query FROM b GROUP BY conv_id""")
def similarity_query(spark, sf):
    tf, stats = _context_terms(spark, sf)
    terms = s.interesting_terms(tf, stats, F.col("n"), ["owner", "conv_id"], ["owner"], 10)
    return s.similarity_query(terms, ["conv_id"])


# Candidates are the documents that hold the first message of a completed conversation with the same support area (none
# where the asking conversation has none); the terms are those of the asking conversation's context, skipped messages
# included.
_RELATED_SQL = f"""WITH {_DOCS_SQL}{_START_SQL}, firsts AS (SELECT conv_id, owner, coalesce(support_area, '') AS area, completed,
  votes FROM docs WHERE idx = 0),
ftf AS (SELECT tf.conv_id, tf.owner, term, tf FROM tf WHERE idx = 0),
fdf AS (SELECT owner, term, count(*) AS df FROM ftf GROUP BY ALL),
fn AS (SELECT owner, count(*) AS n FROM firsts GROUP BY owner), fdfn AS (SELECT * FROM fdf JOIN fn USING (owner)),
qt AS (SELECT m.conv_id, c.owner, lower(unnest(list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> ''))) AS term FROM msg m JOIN conv c USING (conv_id) JOIN starts USING (conv_id)
    WHERE deleted IS NULL AND NOT private AND m.idx >= start),
qtf AS (SELECT conv_id, owner, term, count(*) AS tf FROM qt GROUP BY ALL),
{_IT_SQL.format(key='owner, conv_id', tf='qtf', df='fdfn', on='owner, term', n='')},
boosts AS (SELECT *, weight / max(weight) OVER (PARTITION BY conv_id) AS boost FROM it WHERE rank <= 10),
scored AS (SELECT b.conv_id AS query_id, f.conv_id, round(sum(boost * f.tf * (1 + ln((n + 1) / (df + 1)))), 6)
    AS score FROM boosts b JOIN ftf f ON f.owner = b.owner AND f.term = b.term
    JOIN fdfn d ON d.owner = b.owner AND d.term = b.term JOIN firsts fc ON fc.conv_id = f.conv_id
    JOIN conv qc ON qc.conv_id = b.conv_id WHERE b.conv_id <> f.conv_id AND fc.completed
    AND fc.area = coalesce(qc.support_area, '') GROUP BY ALL),
related AS (SELECT * FROM (SELECT s.*, votes, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, votes DESC, s.conv_id) AS rank FROM scored s JOIN firsts USING (conv_id)) WHERE rank <= 3)"""


def _related(spark, sf, **options):
    docs = written(_docs(spark, sf), "docs")
    area = F.coalesce(F.get("support_area", F.lit(0)), F.lit("")).alias("area")
    firsts = docs.filter("idx = 0").select("conv_id", "owner", area, "completed", "content", "votes")
    all_tf = s.postings(firsts, ["conv_id", "owner", "area", "completed"]).drop("len")
    sizes = firsts.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    # candidates and questions meet within (owner, area); the frequencies are those of the owner
    stats = written(s.term_stats(all_tf, ["owner"]).join(sizes, "owner"), "stats")
    tf, firsts = (df.filter("completed").drop("completed") for df in (all_tf, firsts))
    conv = ad.conversations(spark, sf).filter("deleted is null").select("conv_id", "owner", F.coalesce(F.get(
        F.try_element_at("properties", F.lit("support_area")), F.lit(0)), F.lit("")).alias("area"))
    every = ad.messages(spark, sf)
    msg = f.in_context(every, w.context_start(every)).filter("not private").select("conv_id", "content")
    asked = (s.doc_terms(msg).drop("len").groupBy("conv_id", "term").agg(F.sum("tf").alias("tf"))
             .join(conv, "conv_id"))
    terms = s.interesting_terms(asked, stats, F.col("n"), ["owner", "area", "conv_id"], ["owner"], 10)
    queries = written(terms.select("conv_id", "owner", "area", "term", "boost"), "queries")
    return docs, s.related(queries, tf, firsts.drop("content"), stats, F.col("n"), ["owner", "area"], "conv_id", **options)


@query(f"{_RELATED_SQL} SELECT query_id, conv_id, score, votes, CAST(rank AS INTEGER) AS rank FROM related")
def related_conversations(spark, sf):
    _, found = _related(spark, sf)
    return found.select("query_id", "conv_id", "score", "votes", "rank")


@query(f"{_RELATED_SQL.replace('WHERE rank <= 3)', 'WHERE rank > 1 AND rank <= 4)')} SELECT query_id, conv_id, score, votes, "
       "CAST(rank AS INTEGER) AS rank FROM related")
def related_conversations_after_the_first(spark, sf):
    _, found = _related(spark, sf, start=1)
    return found.select("query_id", "conv_id", "score", "votes", "rank")


@query(f"{_RELATED_SQL} SELECT query_id, conv_id, score, votes, CAST(rank AS INTEGER) AS rank FROM related")
def related_conversations_by_lists(spark, sf):
    """The same result when almost every term counts as frequent and its list is read a few entries at a time."""
    _, found = _related(spark, sf, light_df=2, depth=4)
    return found.select("query_id", "conv_id", "score", "votes", "rank")


@query(f"""{_RELATED_SQL}, answers AS (SELECT conv_id, idx, t, content, row_number() OVER (PARTITION BY conv_id
  ORDER BY t, idx) AS answer_rank FROM docs WHERE len(list_filter(idxs, lambda i: i >= 1)) > 0)
SELECT query_id, r.conv_id, a.idx AS answer_idx, CAST(answer_rank AS INTEGER) AS answer_rank, length(a.content)
  AS answer_length FROM related r JOIN answers a ON a.conv_id = r.conv_id""")
def related_answers(spark, sf):
    docs, found = _related(spark, sf)
    return s.related_answers(found.select("query_id", "conv_id"), docs).select(
        "query_id", "conv_id", "answer_idx", "answer_rank", F.length("answer").alias("answer_length"))


@query(f"""WITH {_DOCS_SQL}
SELECT 'owner' AS field, owner AS value, count(*) AS n FROM docs GROUP BY owner
UNION ALL SELECT 'completed', CAST(completed AS VARCHAR), count(*) FROM docs GROUP BY completed
UNION ALL SELECT 'support_area', support_area, count(*) FROM docs WHERE support_area IS NOT NULL
  GROUP BY support_area""")
def facet_counts(spark, sf):
    docs = _docs(spark, sf).withColumn("support_area", F.get("support_area", F.lit(0)))
    return s.facet_counts(docs, ["owner", "completed", "support_area"])


@query(f"""{_HITS_SQL} SELECT query_id, h.conv_id, h.idx, status, domain FROM hits h JOIN conv USING (conv_id)
WHERE deleted IS NULL AND status = 'Complete'""")
def hydrate_hits(spark, sf):
    _, hits = _search(spark, sf)
    conv = ad.conversations(spark, sf).filter("status = 'Complete'").select(
        "conv_id", "status", "context.domain", "deleted")
    return s.hydrate_hits(hits, conv).select("query_id", "conv_id", "idx", "status", "domain")


@query(f"{_HITS_SQL} SELECT query_id, h.conv_id, unnest(idxs) AS idx, score FROM hits h JOIN docs d "
       "ON d.conv_id = h.conv_id AND d.idx = h.idx")
def hits_to_messages(spark, sf):
    docs, hits = _search(spark, sf)
    return s.hits_to_messages(hits, docs).select("query_id", "conv_id", "idx", "score")


@query("SELECT doc_id, concat(text, chr(10), lang) AS text_all, concat(source, chr(10), lang) AS iterms FROM documents")
def copy_fields(spark, sf):
    docs = ad.documents(spark, sf).select("doc_id", F.col("text").alias("message"), F.col("lang").alias("keyword_lang"),
                                          "source")
    copied = s.copy_fields(docs, {"text_all": ["message*", "keyword*"], "iterms": ["source", "keyword_lang"]})
    return copied.select("doc_id", "text_all", "iterms")
