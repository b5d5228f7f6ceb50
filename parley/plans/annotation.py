"""Span and token queries.

The driver tables carry no language annotations, so part of speech, entities and the like are taken from the length and
the first letter of each word; the operators do not care where a span table comes from.
"""

from pyspark.sql import Window, functions as F

from parley import adapters as ad
from parley.adapters import CONV_SQL, MSG_SQL
from parley.operators import annotate as a
from parley.operators import filters as f
from parley.operators import queries as q
from parley.operators import windows as w
from parley.plans.registry import query
from parley.plans.retrieval import (
    _context_terms, _conversation_interests, _conversation_terms, _CONTEXT_TERMS_SQL, _CONV_TERMS_SQL)
from parley.plans.sequences import _START_SQL

# The analysis window of the query builders; shorter than many chats, so that it cuts.
WINDOW = 4
_WINDOWED_SQL = MSG_SQL.replace("msg AS (", "every AS (", 1) + f""",
msg AS (SELECT * EXCLUDE (top) FROM (SELECT *, max(idx) OVER (PARTITION BY conv_id) AS top FROM every)
  WHERE idx > top - {WINDOW})"""


def _windowed(sql):
    """A twin over the messages of the analysis window."""
    return sql.replace(MSG_SQL, _WINDOWED_SQL, 1)


_WORDS_SQL = f"""WITH {MSG_SQL},
src AS (SELECT conv_id, idx AS msg_idx, unnest(ps) AS text, generate_subscripts(ps, 1) AS n FROM (SELECT conv_id, idx,
  regexp_extract_all(content, '\\p{{L}}+|\\p{{N}}+|[^\\p{{L}}\\p{{N}}]+') AS ps FROM msg)),
placed AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, msg_idx ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM src),
words AS (SELECT conv_id, msg_idx, text, start, CAST(start + length(text) AS INTEGER) AS "end",
  CASE WHEN regexp_matches(text, '^\\p{{N}}') THEN 'CARD' WHEN regexp_matches(text, '^\\p{{Lu}}') THEN 'NOUN'
    WHEN length(text) % 5 = 0 THEN 'ADJA' WHEN length(text) % 7 = 0 THEN 'APPR' ELSE 'X' END AS pos,
  CASE WHEN length(text) % 3 = 0 THEN lower(text) END AS lemma, (length(text) % 9 + 1) / 10.0::DOUBLE AS prob
  FROM placed WHERE regexp_matches(text, '^[\\p{{L}}\\p{{N}}]')),
spread AS (SELECT *, length(text) AS len, CASE WHEN length(text) % 5 = 3 THEN coalesce(lead("end") OVER (
  PARTITION BY conv_id, msg_idx ORDER BY start), "end") ELSE "end" END AS far FROM words),
chunks AS (SELECT s.conv_id, s.msg_idx, start, far AS "end", substring(content, start + 1, far - start) AS text,
  CASE len % 4 WHEN 0 THEN 'location' WHEN 1 THEN 'organization' WHEN 2 THEN 'misc' END AS ner_type,
  concat('tag', len % 3) AS ner_tag, CASE WHEN len % 2 = 0 THEN prob END AS prob, lemma, len % 6 = 1 AS negated
  FROM spread s JOIN msg ON msg.conv_id = s.conv_id AND msg.idx = s.msg_idx WHERE len % 4 <> 3 AND len > 4)"""


def _texts(msg):
    return msg.select("conv_id", F.col("idx").alias("msg_idx"), F.col("content").alias("text"))


def _words(msg):
    length = F.length("text")
    return a.message_words(msg).select(
        "conv_id", "msg_idx", F.lit("word").alias("kind"), "start", "end", "text",
        F.when(F.col("text").rlike(r"^\p{N}"), "CARD").when(F.col("text").rlike(r"^\p{Lu}"), "NOUN")
        .when(length % 5 == 0, "ADJA").when(length % 7 == 0, "APPR").otherwise("X").alias("pos"),
        F.when(length % 3 == 0, F.lower("text")).alias("lemma"), ((length % 9 + 1) / 10.0).alias("prob"),
        (length == 4).alias("stopword"))


def _chunks(msg, words):
    order = Window.partitionBy("conv_id", "msg_idx").orderBy("start")
    length = F.length("text")
    far = F.when(length % 5 == 3, F.coalesce(F.lead("end").over(order), F.col("end"))).otherwise(F.col("end"))
    spread = words.withColumn("_far", far).withColumn("_len", length).filter("_len % 4 <> 3 and _len > 4")
    return spread.drop("text").join(_texts(msg), ["conv_id", "msg_idx"]).select(
        "conv_id", "msg_idx", F.lit("chunk").alias("kind"), "start", F.col("_far").alias("end"),
        F.expr("substring(text, start + 1, _far - start)").alias("text"),
        F.expr("case _len % 4 when 0 then 'location' when 1 then 'organization' when 2 then 'misc' end").alias("ner_type"),
        F.expr("concat('tag', _len % 3)").alias("ner_tag"), F.expr("case when _len % 2 = 0 then prob end").alias("prob"),
        "lemma", F.expr("_len % 6 = 1").alias("negated"))


@query(f'{_WORDS_SQL} SELECT conv_id, msg_idx, text, start, "end", pos FROM words')
def message_words(spark, sf):
    return _words(ad.messages(spark, sf)).select("conv_id", "msg_idx", "text", "start", "end", "pos")


@query("""WITH f AS (SELECT page_id, regexp_extract_all(html, p) AS found, regexp_split_to_array(html, p) AS gaps FROM
  (SELECT page_id, concat(html, ' ', url, ' khttp://no.such/ FTP://Foo.com/a_b see ', url) AS html,
   '(?i)\\b(?:https?|ftp)://(?:-\\.)?(?:[^\\s/?\\.#-]+\\.?)+(?:/[^\\s]*)?' AS p FROM pages)),
n AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM f)
SELECT page_id, CAST(k AS INTEGER) AS n, found[k] AS text, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g)))
  + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: length(g))), 0) AS INTEGER) AS start FROM n""")
def url_entities(spark, sf):
    pages = ad.pages(spark, sf).select(
        F.col("page_id").alias("conv_id"), F.lit(0).alias("idx"),
        F.concat("html", F.lit(" "), "url", F.lit(" khttp://no.such/ FTP://Foo.com/a_b see "), "url").alias("content"))
    order = Window.partitionBy("conv_id").orderBy("start")
    return a.url_entities(pages).select(F.col("conv_id").alias("page_id"), F.row_number().over(order).alias("n"),
                                        "text", "start")


# Dictionary: every part name and brand, with the words of the chat itself as surfaces so that there are matches.
_VOCAB_SQL = """vocab AS (SELECT p_type AS label, p_name AS surface FROM part UNION
  SELECT concat('L:', term), term FROM (SELECT lower(text) AS term, count(*) AS n FROM words GROUP BY 1) WHERE n % 10 = 3
  UNION SELECT 'pair', concat(text, '-', nxt) FROM (SELECT text, lead(text) OVER (PARTITION BY conv_id, msg_idx
    ORDER BY start) AS nxt FROM words) WHERE length(text) = 5 AND length(nxt) = 5)"""


def _vocabulary(spark, sf, words):
    part = ad.table(spark, sf, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("surface"))
    counted = words.groupBy(F.lower("text").alias("surface")).agg(F.count(F.lit(1)).alias("n")).filter("n % 10 = 3")
    order = Window.partitionBy("conv_id", "msg_idx").orderBy("start")
    pairs = words.withColumn("_next", F.lead("text").over(order)).filter("length(text) = 5 and length(_next) = 5")
    return (part.union(counted.select(F.concat(F.lit("L:"), "surface"), "surface"))
            .union(pairs.select(F.lit("pair"), F.concat_ws("-", "text", "_next"))).distinct())


@query(f"""{_WORDS_SQL}, {_VOCAB_SQL},
entries AS (SELECT DISTINCT label, regexp_replace(surface, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS entry FROM vocab),
seq AS (SELECT *, row_number() OVER (PARTITION BY conv_id, msg_idx ORDER BY start) AS r FROM words),
shingles AS (SELECT conv_id, msg_idx, start, "end", text AS surface FROM seq
  UNION ALL SELECT x.conv_id, x.msg_idx, x.start, y."end", concat(x.text, ' ', y.text) FROM seq x JOIN seq y
    ON y.conv_id = x.conv_id AND y.msg_idx = x.msg_idx AND y.r = x.r + 1)
SELECT DISTINCT conv_id, msg_idx AS message_idx, start, "end", label AS value FROM shingles JOIN entries
  ON lower(entry) = lower(surface) WHERE entry = surface
  OR NOT (regexp_matches(entry, '\\p{{Lu}}') AND NOT regexp_matches(entry, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]'))""")
def vocabulary_entities(spark, sf):
    words = _words(ad.messages(spark, sf))
    found = a.vocabulary_entities(words, ad.stored(_vocabulary(spark, sf, words)))
    return found.select("conv_id", "message_idx", "start", "end", "value")


def _tokens(spark, sf, window=0):
    """Tokens: every chunk as a token of the type its entity label gives, of all or the last ``window`` messages."""
    msg = ad.messages(spark, sf)
    if window:
        msg = ad.stored(w.analysis_window(msg, window))
    words = _words(msg)
    chunks = _chunks(msg, words)
    length = F.length("text")
    tokens = chunks.select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end", F.substring("text", 1, 3).alias("value"),
        F.expr("case when length(text) % 9 = 0 then 'Keyword' when ner_type = 'location' then 'Place' when ner_type = "
               "'organization' then 'Organization' when length(text) % 10 = 0 then 'Topic' else 'Entity' end").alias("type"),
        F.array(F.concat(F.lit("h"), (length % 3).cast("string"))).alias("hints"),
        ((length % 8) / 10.0).alias("confidence"))
    return msg, words, chunks, tokens


_TOKENS_SQL = f"""{_WORDS_SQL}, tokens AS (SELECT conv_id, msg_idx AS message_idx, start, "end",
  substring(text, 1, 3) AS value, CASE WHEN length(text) % 9 = 0 THEN 'Keyword' WHEN ner_type = 'location' THEN 'Place'
    WHEN ner_type = 'organization' THEN 'Organization' WHEN length(text) % 10 = 0 THEN 'Topic' ELSE 'Entity' END AS type,
  concat('h', length(text) % 3) AS hint, (length(text) % 8) / 10.0::DOUBLE AS confidence FROM chunks),
ranked AS (SELECT *, list_position(['Date', 'Topic', 'Entity', 'Place', 'Organization', 'Person', 'Product',
  'Attribute', 'Term', 'Keyword', 'Other'], type) AS rank FROM tokens),
indexed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY message_idx, start, "end" DESC, rank, value) - 1
  AS token_idx FROM ranked)"""


@query(f"{_TOKENS_SQL} SELECT conv_id, token_idx, message_idx, start, type, value FROM indexed")
def order_tokens(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    return a.index_tokens(tokens).select("conv_id", "token_idx", "message_idx", "start", "type", "value")


@query(f"""{_WORDS_SQL} SELECT conv_id, msg_idx AS message_idx, start, "end", text AS value, problems FROM words,
  (SELECT 2 AS problems) WHERE length(text) = 11""")
def run_extractors(spark, sf):
    """Three stages: one gives tokens, one fails when it is planned, one when it runs."""
    def long_words(_, words):
        return words.filter("length(text) = 11").select(
            "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end", F.col("text").alias("value"),
            F.lit("Term").alias("type"), F.array().cast("array<string>").alias("hints"), F.lit(1.0).alias("confidence"))

    def no_such_column(_, words):
        return words.select("nothing")

    def fails_on_rows(given, words):
        return long_words(given, words).withColumn("value", F.raise_error(F.lit("no model")).cast("string"))

    msg, problems = ad.messages(spark, sf), []
    found = a.run_extractors([no_such_column, long_words, fails_on_rows], msg, _words(msg), problems)
    return a.union_tokens(*found).select("conv_id", "message_idx", "start", "end", "value", F.lit(len(problems)).alias(
        "problems"))


@query(f"""{_TOKENS_SQL} SELECT conv_id, message_idx, start, value, CASE WHEN type <> 'Entity' THEN type
  WHEN regexp_matches(value, '^\\p{{Lu}}') THEN 'Person' WHEN confidence > 0.4 THEN 'Product' ELSE 'Unknown' END AS type
FROM tokens""")
def classify_tokens(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    unknown = tokens.withColumn("type", F.when(F.col("type") == "Entity", "Unknown").otherwise(F.col("type")))
    return a.classify_tokens(unknown, [(F.col("value").rlike(r"^\p{Lu}"), "Person"), (
        F.col("confidence") > 0.4, F.lit("Product"))]).select("conv_id", "message_idx", "start", "value", "type")


# Sections: stretches of words from every word to the next long one, whole halves of the message around them.
@query(f"""{_WORDS_SQL}, sec AS (SELECT DISTINCT conv_id, msg_idx, start, far AS "end" FROM spread WHERE len % 5 = 3
  UNION SELECT conv_id, msg_idx, 0, CAST(max("end") AS INTEGER) FROM words WHERE msg_idx % 2 = 0 GROUP BY ALL),
leaf AS (SELECT * FROM sec s WHERE NOT EXISTS (SELECT 1 FROM sec i WHERE i.conv_id = s.conv_id AND i.msg_idx = s.msg_idx
  AND (i.start > s.start OR i.start = s.start AND i."end" < s."end") AND i.start < s."end"))
SELECT * FROM leaf UNION ALL SELECT conv_id, idx, 0, CAST(length(content) AS INTEGER) FROM msg
WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.conv_id = msg.conv_id AND sec.msg_idx = msg.idx)""")
def content_sections(spark, sf):
    msg = ad.messages(spark, sf)
    words = _words(msg)
    order = Window.partitionBy("conv_id", "msg_idx").orderBy("start")
    near = words.withColumn("_far", F.coalesce(F.lead("end").over(order), F.col("end"))).filter(
        F.length("text") % 5 == 3).select("conv_id", "msg_idx", "start", F.col("_far").alias("end"))
    whole = words.filter("msg_idx % 2 = 0").groupBy("conv_id", "msg_idx").agg(
        F.lit(0).alias("start"), F.max("end").alias("end")).select("conv_id", "msg_idx", "start", "end")
    sections = near.unionByName(whole).withColumn("kind", F.lit("section"))
    return a.content_sections(sections, _texts(msg))


# Stop words: short starts of words, some only in upper case.
_STOP_SQL = """stop(lang, key, variant) AS (VALUES (NULL, 'ent', 'ent'), ('de', 'ein', 'ein'), ('de', 'lin', 'LIN'),
  ('en', 'her', 'her'))"""


def _stop(spark):
    return spark.createDataFrame(
        [(None, "ent", ["ent"]), ("de", "ein", ["ein"]), ("de", "lin", ["LIN"]), ("en", "her", ["her"])],
        "lang string, key string, variants array<string>")


@query(f"""{_TOKENS_SQL}, {_STOP_SQL}, t AS (SELECT *, CASE WHEN start % 2 = 0 AND value NOT LIKE '%ß%' THEN upper(value) ELSE value END AS v
  FROM tokens)
SELECT conv_id, message_idx, start, type, v AS value FROM t WHERE NOT EXISTS (SELECT 1 FROM stop
  WHERE (lang IS NULL OR lang = 'de') AND key = lower(v) AND (variant = v OR NOT (regexp_matches(v, '\\p{{Lu}}')
    AND NOT regexp_matches(v, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]'))))""")
def remove_stopwords(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    cased = tokens.withColumn("value", F.when(F.expr("start % 2 = 0 and not contains(value, 'ß')"), F.upper("value")).otherwise(F.col("value")))
    return a.remove_stopwords(cased, _stop(spark), "de").select("conv_id", "message_idx", "start", "type", "value")


@query(f"{_TOKENS_SQL} SELECT conv_id, message_idx, start, type FROM tokens WHERE confidence >= 0.2 AND type <> 'Topic'")
def filter_tokens(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    kept = a.filter_tokens(tokens, [F.col("confidence") < 0.2, F.col("type") == "Topic"])
    return kept.select("conv_id", "message_idx", "start", "type")


@query(f"""{_TOKENS_SQL} SELECT conv_id, message_idx, start, "end", type, EXISTS (SELECT 1 FROM chunks c WHERE c.negated
  AND c.conv_id = t.conv_id AND c.msg_idx = t.message_idx AND c.start <= t.start AND c."end" >= t."end") AS negated
FROM tokens t""")
def mark_negated(spark, sf):
    _, _, chunks, tokens = _tokens(spark, sf)
    return a.mark_negated(tokens, chunks).select(
        "conv_id", "message_idx", "start", "end", "type", F.array_contains("hints", "negated").alias("negated"))


@query(f"""{_TOKENS_SQL} SELECT conv_id, message_idx, start, "end", type FROM tokens t WHERE EXISTS (SELECT 1 FROM words w
  WHERE w.conv_id = t.conv_id AND w.msg_idx = t.message_idx AND w.start >= t.start AND w."end" <= t."end"
  AND w.pos IN ('NOUN', 'ADJA'))""")
def entities_with_content_word(spark, sf):
    _, words, _, tokens = _tokens(spark, sf)
    return a.entities_with_content_word(tokens, words).select("conv_id", "message_idx", "start", "end", "type")


@query(f"""{_WORDS_SQL} SELECT conv_id, msg_idx AS message_idx, start, "end", text AS value,
  prob AS confidence FROM words WHERE pos = 'ADJA' AND length(text) <> 4 AND regexp_matches(text, '^[\\p{{L}}_-]+$')
  AND lower(text) NOT IN ('komisch', 'nächste', 'kommende')""")
def adjective_tokens(spark, sf):
    return f.adjective_tokens(_words(ad.messages(spark, sf))).select(
        "conv_id", "message_idx", "start", "end", "value", "confidence")


@query(f"""{_WORDS_SQL} SELECT conv_id, msg_idx, start, text FROM words JOIN (SELECT conv_id AS c, idx FROM msg
  WHERE origin = 'User') u ON u.c = conv_id AND u.idx = msg_idx""")
def user_origin_only(spark, sf):
    msg = ad.messages(spark, sf)
    return f.user_origin_only(_words(msg), msg).select("conv_id", "msg_idx", "start", "text")


_INTERESTS_SQL = """terms AS (SELECT conv_id, term, weight / max(weight) OVER (PARTITION BY conv_id) AS boost FROM it
  WHERE rank <= 10)"""


def _interest_sql():
    """Words and interesting terms in one statement."""
    rest = _CONV_TERMS_SQL[_CONV_TERMS_SQL.index("conv AS ("):]
    return f"""{_WORDS_SQL}, {rest}, {_INTERESTS_SQL},
ann AS (SELECT DISTINCT w.conv_id, w.msg_idx, w.start, t.term, round(boost, 6) AS prob FROM words w JOIN terms t
  ON t.conv_id = w.conv_id AND (t.term = w.text OR t.term = lower(w.text) OR t.term = w.lemma)
  WHERE w.pos IN ('NOUN', 'ADJA'))"""


def _annotations(spark, sf, words):
    terms = _conversation_interests(spark, sf).select("conv_id", "term", F.round("boost", 6).alias("_prob"))
    return a.match_terms_to_words(terms, words).select(
        "conv_id", "msg_idx", "start", "term", F.lit("own").alias("source"), F.col("_prob").alias("prob"))


@query(f"{_interest_sql()} SELECT conv_id, msg_idx, start, term, prob FROM ann")
def match_terms_to_words(spark, sf):
    return _annotations(spark, sf, _words(ad.messages(spark, sf))).drop("source")


@query(f"""{_interest_sql()},
sections AS (SELECT conv_id, msg_idx, "end" FROM words WHERE length(text) % 6 = 0),
m AS (SELECT w.*, pos IN ('NOUN', 'ADJA', 'CARD') AS interesting, pos IN ('NOUN', 'ADJA', 'CARD', 'APPR') AS member,
  EXISTS (SELECT 1 FROM sections s WHERE s.conv_id = w.conv_id AND s.msg_idx = w.msg_idx AND s."end" = w."end") AS closes
  FROM words w),
o AS (SELECT *, CASE WHEN member AND coalesce(lag(member) OVER q, false) AND NOT coalesce(lag(closes) OVER q, false)
  THEN 0 ELSE 1 END AS opens FROM m WINDOW q AS (PARTITION BY conv_id, msg_idx ORDER BY start)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, msg_idx ORDER BY start) AS run FROM o),
b AS (SELECT conv_id, msg_idx, run, min(start) FILTER (interesting) AS s, max("end") FILTER (pos = 'NOUN') AS e,
  count(*) FILTER (interesting) AS n FROM r WHERE member GROUP BY ALL),
p AS (SELECT b.conv_id, b.msg_idx, s, e, n, avg(x.prob) AS confidence FROM b
  JOIN r USING (conv_id, msg_idx, run) JOIN (SELECT conv_id, msg_idx, start AS at, prob FROM ann) x
    ON x.conv_id = b.conv_id AND x.msg_idx = b.msg_idx AND x.at = r.start
  WHERE e IS NOT NULL AND r.interesting AND r."end" <= e GROUP BY b.conv_id, b.msg_idx, s, e, n)
SELECT p.conv_id, p.msg_idx AS message_idx, s AS start, e AS "end", substring(content, s + 1, e - s) AS value,
  round(confidence, 4) AS confidence FROM p JOIN msg ON msg.conv_id = p.conv_id AND msg.idx = p.msg_idx
WHERE confidence > 0""")
def keyword_phrases(spark, sf):
    msg = ad.messages(spark, sf)
    words = _words(msg)
    sections = words.filter("length(text) % 6 = 0").select("conv_id", "msg_idx", "end")
    found = a.keyword_phrases(words, sections, _annotations(spark, sf, words).drop("term"), _texts(msg))
    return found.select("conv_id", "message_idx", "start", "end", "value", F.round("confidence", 4).alias("confidence"))


@query(f"""{_WORDS_SQL}, loc AS (SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY conv_id, msg_idx
    ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chunks
  WHERE ner_type = 'location') WHERE reach IS NULL OR "end" > reach)
SELECT c.conv_id, c.msg_idx, w.start, c."end", round((w.prob + coalesce(c.prob, 0)) / (1 + w.prob * coalesce(c.prob, 0)),
  6) AS prob FROM loc c JOIN words w ON w.conv_id = c.conv_id AND w.msg_idx = c.msg_idx AND w.pos = 'ADJA'
  AND w.start < c.start AND w."end" > coalesce(c.reach, -1)
  AND NOT EXISTS (SELECT 1 FROM words x WHERE x.conv_id = c.conv_id AND x.msg_idx = c.msg_idx AND x.start > w.start
    AND x.start < c.start)
  AND NOT EXISTS (SELECT 1 FROM loc x WHERE x.conv_id = c.conv_id AND x.msg_idx = c.msg_idx AND x.start >= w.start
    AND x.start < c.start AND x."end" > w."end")
  AND NOT EXISTS (SELECT 1 FROM loc x WHERE x.conv_id = c.conv_id AND x.msg_idx = c.msg_idx AND x.start <= w.start
    AND x."end" >= w."end")""")
def adjective_locations(spark, sf):
    msg = ad.messages(spark, sf)
    words = _words(msg)
    found = a.adjective_locations(words, _chunks(msg, words), _texts(msg))
    return found.select("conv_id", "msg_idx", "start", "end", F.round("prob", 6).alias("prob"))


_MERGED_PROB = """CASE WHEN {p} IS NOT NULL OR {q} IS NOT NULL
    THEN (coalesce({p}, 1) + coalesce({q}, 1)) / (1 + coalesce({p}, 1) * coalesce({q}, 1)) END"""


@query(f"""{_WORDS_SQL}, reached AS (SELECT *, coalesce(max("end") OVER (PARTITION BY conv_id, msg_idx
    ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach
  FROM chunks WHERE ner_type IN ('location', 'organization')),
followed AS (SELECT o.*, (SELECT min(w.start) FROM words w WHERE w.conv_id = o.conv_id AND w.msg_idx = o.msg_idx
    AND w.start >= o."end") AS next_word FROM reached o WHERE "end" > reach),
linked AS (SELECT *, CASE WHEN ner_type = 'location' AND lag(next_word) OVER w = start THEN 0 ELSE 1 END AS opens
  FROM followed WINDOW w AS (PARTITION BY conv_id, msg_idx ORDER BY start, "end" DESC)),
chained AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, msg_idx ORDER BY start, "end" DESC) AS chain FROM linked),
paired AS (SELECT *, row_number() OVER w AS n, lead(start) OVER w AS f_start, lead("end") OVER w AS f_end,
    lead(text) OVER w AS f_text, lead(lemma) OVER w AS f_lemma, lead(prob) OVER w AS f_prob
  FROM chained WINDOW w AS (PARTITION BY conv_id, msg_idx, chain ORDER BY start)),
tailed AS (SELECT o.conv_id, o.msg_idx, o.start, o."end", o.text, {_MERGED_PROB.format(p='o.prob', q='i.prob')} AS prob,
    coalesce(o.lemma, CASE WHEN i.lemma IS NOT NULL THEN concat(substring(content, o.start + 1, i.start - o.start), i.lemma) END)
    AS lemma
  FROM followed o JOIN reached i ON i.conv_id = o.conv_id AND i.msg_idx = o.msg_idx AND i."end" = o."end"
    AND i."end" <= i.reach AND i.ner_type = 'location' JOIN msg m ON m.conv_id = o.conv_id AND m.idx = o.msg_idx
  WHERE o.ner_type = 'organization')
SELECT p.conv_id, msg_idx, start, f_end AS "end", substring(content, start + 1, f_end - start) AS text,
  round({_MERGED_PROB.format(p='prob', q='f_prob')}, 6) AS prob, CASE WHEN lemma IS NOT NULL OR f_lemma IS NOT NULL
    THEN concat(coalesce(lemma, text), substring(content, "end" + 1, f_start - "end"), coalesce(f_lemma, f_text)) END AS lemma
FROM paired p JOIN msg m ON m.conv_id = p.conv_id AND m.idx = p.msg_idx WHERE n % 2 = 1 AND f_start IS NOT NULL
UNION ALL SELECT conv_id, msg_idx, start, "end", text, round(prob, 6), lemma FROM tailed""")
def append_location_type(spark, sf):
    msg = ad.messages(spark, sf)
    words = _words(msg)
    return a.append_location_type(words, _chunks(msg, words), _texts(msg)).select(
        "conv_id", "msg_idx", "start", "end", "text", F.round("prob", 6).alias("prob"), "lemma")


@query(f"""{_WORDS_SQL}, t AS (SELECT *, CASE ner_type WHEN 'location' THEN 'Place' WHEN 'organization' THEN 'Organization'
    ELSE 'Entity' END AS type FROM chunks),
o AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY conv_id, msg_idx, type ORDER BY start, "end" DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM t),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, msg_idx, type ORDER BY start, "end" DESC) AS n FROM o),
m AS (SELECT conv_id, msg_idx, type, min(start) AS s, max("end") AS e, min_by("end", start) AS first_end,
  min_by(coalesce(lemma, text), start) AS lemma, count(*) AS parts,
  list_reduce(list(coalesce(prob, 0.8) ORDER BY start), lambda x, y: (x + y) / (1 + x * y)) AS confidence,
  list_distinct(list(CASE type WHEN 'Entity' THEN concat('entity.type.', ner_tag) ELSE concat('entity.type.', ner_type) END))
    AS hints FROM g GROUP BY conv_id, msg_idx, type, n)
SELECT m.conv_id, m.msg_idx AS message_idx, s AS start, e AS "end", type, round(confidence, 6) AS confidence,
  CASE WHEN e > first_end THEN substring(content, s + 1, e - s) ELSE lemma END AS value,
  array_to_string(list_sort(hints), ',') AS hints
FROM m JOIN msg ON msg.conv_id = m.conv_id AND msg.idx = m.msg_idx""")
def entity_tokens(spark, sf):
    msg = ad.messages(spark, sf)
    return a.entity_tokens(_chunks(msg, _words(msg)), _texts(msg)).select(
        "conv_id", "message_idx", "start", "end", "type", F.round("confidence", 6).alias("confidence"), "value",
        F.array_join("hints", ",").alias("hints"))


@query(f"""{_TOKENS_SQL}, v AS (SELECT * REPLACE (substring(value, 1, 1) AS value) FROM tokens),
s AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER o AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS c
  FROM v WINDOW o AS (PARTITION BY conv_id, message_idx, type ORDER BY start, "end" DESC, value)),
st AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, message_idx, type ORDER BY start, "end" DESC, value) AS stretch FROM s),
k AS (SELECT x.*, (SELECT max(y.start) FROM st y WHERE y.conv_id = x.conv_id AND y.message_idx = x.message_idx AND
    y.type = x.type AND y.stretch = x.stretch AND (y.start < x.start OR (y.start = x.start AND y."end" >= x."end"))
    AND NOT EXISTS (SELECT 1 FROM st z WHERE z.conv_id = y.conv_id AND z.message_idx = y.message_idx AND z.type = y.type
      AND z.stretch = y.stretch AND z.start < y.start AND z."end" >= y."end")) AS owner FROM st x)
SELECT conv_id, message_idx, type, owner AS start, max("end") FILTER (start = owner) AS "end", any_value(value) AS value,
  array_to_string(list_sort(list_distinct(list(hint))), ',') AS hints
FROM k GROUP BY conv_id, message_idx, type, stretch, owner""")
def merge_contained(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    merged = a.merge_contained(tokens.withColumn("value", F.substring("value", 1, 1)))
    return merged.select("conv_id", "message_idx", "type", "start", "end", "value",
                         F.array_join("hints", ",").alias("hints"))


_LATCH_SQL = f"""{_TOKENS_SQL}, lt AS (SELECT *, CASE type WHEN 'Place' THEN 'location' WHEN 'Topic' THEN 'category'
  ELSE 'alphabet' END AS role FROM indexed),
lb AS (SELECT *, max(confidence) OVER (PARTITION BY conv_id, role, value ORDER BY token_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM lt),
latch AS (SELECT conv_id, 0 AS template_idx, 'ir_latch' AS template_type, role, token_idx, value, type, confidence, message_idx
  FROM lb WHERE best IS NULL OR confidence > best),
rel AS (SELECT conv_id, 1 AS template_idx, 'related.conversation' AS template_type,
  CASE type WHEN 'Keyword' THEN 'Keyword' ELSE 'Term' END AS role, token_idx, value, type, confidence, message_idx
  FROM indexed WHERE type <> 'Topic')"""


@query(f"""{_LATCH_SQL} SELECT conv_id, template_idx, role, token_idx FROM latch
UNION ALL SELECT conv_id, template_idx, role, token_idx FROM rel""")
def build_templates(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    return a.build_templates(a.index_tokens(tokens)).select("conv_id", "template_idx", "role", "token_idx")


# Travel-like templates: roles dealt out by token position.
_TRAVEL_SQL = """travel AS (SELECT conv_id, message_idx AS template_idx, 'Reiseplanung' AS template_type,
  CASE token_idx % 3 WHEN 0 THEN 'from' WHEN 1 THEN 'to' ELSE 'depart' END AS role, token_idx FROM indexed),
filled AS (SELECT t.conv_id, t.template_idx, t.role FROM travel t JOIN indexed i USING (conv_id, token_idx)
  WHERE i.confidence <> 0.7 AND ((t.role IN ('from', 'to') AND i.type = 'Place') OR (t.role = 'depart' AND i.type = 'Date')))"""


@query(f"""{_TOKENS_SQL.replace("THEN 'Organization' WHEN", "THEN 'Date' WHEN")}, {_TRAVEL_SQL}
SELECT t.conv_id, t.template_idx, coalesce(roles, '') AS roles, coalesce(n = 3, false) AS valid
FROM (SELECT DISTINCT conv_id, template_idx FROM travel) t LEFT JOIN (SELECT conv_id, template_idx, count(DISTINCT role) AS n,
  string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM filled GROUP BY ALL) f
  ON f.conv_id = t.conv_id AND f.template_idx = t.template_idx""")
def valid_templates(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    dated = tokens.withColumn("type", F.when(F.col("type") == "Organization", "Date").otherwise(F.col("type")))
    indexed = a.index_tokens(dated).withColumn("state", F.when(F.col("confidence") == 0.7, "Rejected").otherwise(
        "Suggested"))
    role = F.expr("case token_idx % 3 when 0 then 'from' when 1 then 'to' else 'depart' end")
    slots = indexed.select("conv_id", F.col("message_idx").alias("template_idx"), F.lit("Reiseplanung").alias(
        "template_type"), role.alias("role"), F.when(role == "depart", "Date").otherwise("Place").alias("token_type"),
        F.lit(True).alias("required"), "token_idx")
    return a.valid_templates(slots, indexed).select("conv_id", "template_idx", F.array_join("roles", ",").alias("roles"),
                                                    "valid")


@query(f"""{_LATCH_SQL} SELECT conv_id, role, token_idx, value FROM latch WHERE type IN ('Place', 'Keyword')
  AND confidence >= 0""")
def fill_slots(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    indexed = a.index_tokens(tokens)
    return a.fill_slots(a.latch_slots(indexed), indexed, ["Place", "Keyword"]).select(
        "conv_id", "role", "token_idx", "value")


@query(f"""{_LATCH_SQL} SELECT conv_id, role, token_idx, value FROM latch WHERE confidence >= 0.1""")
def accept_tokens(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    indexed = a.index_tokens(tokens)
    return f.accept_tokens(a.latch_slots(indexed), indexed).select("conv_id", "role", "token_idx", "value")


_PHRASES_SQL = """ph AS (SELECT conv_id, confidence, token_idx, value, role,
  regexp_replace(value, '([\\\\+\\-!():^\\[\\]"{}~*?|&;/\\s])', '\\\\\\1', 'g') AS e FROM latch WHERE confidence >= 0.1
  AND regexp_matches(value, '\\S')),
two AS (SELECT conv_id, confidence, token_idx, 1 AS k, concat(CASE role WHEN 'location' THEN 'location' ELSE 'text' END, ':"', e,
    '"^', CAST(confidence AS FLOAT)) AS p FROM ph WHERE role IN ('location', 'alphabet')
  UNION ALL SELECT conv_id, confidence, token_idx, 2, concat('title:"', e, '"^', CAST(CAST(confidence AS FLOAT) * 3::FLOAT
    AS FLOAT)) FROM ph WHERE role IN ('location', 'alphabet'))"""


@query(f"""{_windowed(_LATCH_SQL)}, {_PHRASES_SQL}
SELECT conv_id, coalesce(query, '') AS query FROM (SELECT DISTINCT conv_id FROM latch) LEFT JOIN (SELECT conv_id,
  string_agg(p, ' OR ' ORDER BY confidence DESC, token_idx, k) AS query FROM two GROUP BY conv_id) USING (conv_id)""")
def latch_query(spark, sf):
    _, _, _, tokens = _tokens(spark, sf, WINDOW)
    indexed = a.index_tokens(tokens)
    return q.latch_query(a.latch_slots(indexed), indexed).select("conv_id", "query")


@query(f"""{_windowed(_LATCH_SQL)} SELECT conv_id, string_agg(value, ' ' ORDER BY confidence DESC, token_idx) AS query FROM latch
WHERE confidence >= 0.1 AND role IN ('location', 'alphabet') GROUP BY conv_id""")
def web_query(spark, sf):
    _, _, _, tokens = _tokens(spark, sf, WINDOW)
    indexed = a.index_tokens(tokens)
    return q.web_query(a.latch_slots(indexed), indexed).select("conv_id", "query")


@query(f"""{_windowed(_LATCH_SQL)}{_START_SQL}, v AS (SELECT conv_id, role, value, min(token_idx) AS first_at FROM rel JOIN starts
    USING (conv_id) WHERE message_idx >= start AND value <> '' GROUP BY ALL)
SELECT s.conv_id, string_agg(value, '|' ORDER BY first_at) FILTER (role = 'Keyword') AS keywords,
  string_agg(value, '|' ORDER BY first_at) FILTER (role = 'Term') AS terms FROM starts s LEFT JOIN v USING (conv_id)
GROUP BY s.conv_id""")
def related_search_query(spark, sf):
    msg, _, _, tokens = _tokens(spark, sf, WINDOW)
    indexed = a.index_tokens(tokens)
    built = q.related_search_query(a.related_slots(indexed), indexed, w.context_start(msg))
    return built.select("conv_id", *[F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c) for c in ("keywords", "terms")])


@query(f"""{_TOKENS_SQL}, parent AS (SELECT DISTINCT conv_id, message_idx, CASE WHEN length(value) > 0 AND start % 2 = 0
  THEN 'ReiseplanungBahn' ELSE 'Danke' END AS topic FROM tokens WHERE type = 'Topic' AND confidence >= 0.1),
allt AS (SELECT * FROM parent UNION SELECT conv_id, message_idx, 'Reiseplanung' FROM parent WHERE topic = 'ReiseplanungBahn')
SELECT conv_id, message_idx, string_agg(topic, ',' ORDER BY topic) AS topics, bool_or(topic = 'Reiseplanung') AS travel
FROM allt GROUP BY conv_id, message_idx""")
def topic_set(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    topics = tokens.filter("type = 'Topic'").withColumn("state", F.lit("Suggested")).withColumn(
        "value", F.when(F.col("start") % 2 == 0, "ReiseplanungBahn").otherwise("Danke"))
    return a.topic_set(topics).select("conv_id", "message_idx", F.array_join("topics", ",").alias("topics"),
                                      a.topics_apply(F.col("topics"), ["Reiseplanung"]).alias("travel"))


# One token per word of a length that divides by six, so that masks do not overlap.
_MASK_SQL = f"""{_WORDS_SQL}, mt AS (SELECT conv_id, msg_idx, start, "end", CASE WHEN length(text) % 4 = 0 THEN 'Place'
    ELSE 'Date' END AS type FROM words WHERE length(text) % 6 = 0),
pieces AS (SELECT p.conv_id, p.msg_idx, p.n, p.start, p.text, mt.type, CASE WHEN mt.type IS NULL THEN p.text
    ELSE concat('<', mt.type, '>') END AS piece FROM placed p LEFT JOIN mt ON mt.conv_id = p.conv_id
    AND mt.msg_idx = p.msg_idx AND mt.start = p.start AND mt."end" = p.start + length(p.text)),
offs AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, msg_idx ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset" FROM pieces),
full_text AS (SELECT conv_id, msg_idx, string_agg(piece, '' ORDER BY n) AS masked FROM pieces GROUP BY ALL)"""


def _masked(spark, sf):
    msg = ad.messages(spark, sf)
    tokens = _words(msg).filter("length(text) % 6 = 0").select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end", F.col("text").alias("value"),
        F.expr("case when length(text) % 4 = 0 then 'Place' else 'Date' end").alias("type"),
        F.array().cast("array<string>").alias("hints"), F.lit(0.5).alias("confidence"))
    return a.type_masked_text(tokens, _texts(msg))


@query(f"""{_MASK_SQL} SELECT o.conv_id, o.msg_idx AS message_idx, start, type, "offset", md5(masked) AS masked
FROM offs o JOIN full_text USING (conv_id, msg_idx) WHERE type IS NOT NULL""")
def type_masked_text(spark, sf):
    return _masked(spark, sf).select("conv_id", "message_idx", "start", "type", "offset", F.md5("masked").alias("masked"))


@query(f"""{_MASK_SQL} SELECT o.conv_id, o.msg_idx AS message_idx, start, CASE
  WHEN type = 'Place' AND regexp_matches(substring(masked, 1, "offset"), '(die|the|le) $') THEN 'from'
  WHEN type = 'Place' AND regexp_matches(substring(masked, 1, "offset"), '(und|and|et) $') THEN 'to' ELSE '' END AS hints
FROM offs o JOIN full_text USING (conv_id, msg_idx) WHERE type IS NOT NULL""")
def apply_hint_rules(spark, sf):
    rules = [(r"(?:die|the|le) (<Place>)", ["from"]), (r"(?:und|and|et) (<Place>)", ["to"])]
    return a.apply_hint_rules(_masked(spark, sf), rules).select(
        "conv_id", "message_idx", "start", F.array_join("hints", ",").alias("hints"))


@query(f"""WITH {_CONTEXT_TERMS_SQL}, best AS (SELECT * FROM it WHERE rank <= 10),
src AS (SELECT conv_id, idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, idx,
  regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+') AS ws FROM msg))
SELECT b.conv_id, term, CAST(any_value(rank) AS INTEGER) AS rank, min_by(word, idx * 1000000 + pos) AS word
FROM best b JOIN src ON src.conv_id = b.conv_id AND lower(word) = term JOIN starts ON starts.conv_id = b.conv_id
WHERE src.idx >= start GROUP BY b.conv_id, term""")
def context_terms(spark, sf):
    msg = ad.messages(spark, sf)
    tf, stats = _context_terms(spark, sf)
    terms, _, _ = q.context_terms(msg, tf, stats, F.col("n"), ["owner"])
    return terms.select("conv_id", "term", "rank", "word")


@query(f"""{_LATCH_SQL}, {CONV_SQL}, old AS (SELECT conv_id, 0 AS template_idx, concat('queryBuilder:google:', owner)
    AS creator, 'Confirmed' AS state FROM conv WHERE conv_id % 2 = 0),
new AS (SELECT DISTINCT l.conv_id, 0 AS template_idx, concat('queryBuilder:google:', owner) AS creator
  FROM latch l JOIN conv USING (conv_id))
SELECT n.conv_id, n.creator, coalesce(o.state, 'Suggested') AS state, owner <> 'o2' AS routed
FROM new n LEFT JOIN old o USING (conv_id, creator) JOIN conv USING (conv_id)""")
def keep_states(spark, sf):
    _, _, _, tokens = _tokens(spark, sf)
    owners = ad.conversations(spark, sf).select("conv_id", F.col("owner").alias("client"))
    creator = F.concat(F.lit("queryBuilder:google:"), "client").alias("creator")
    slots = a.latch_slots(a.index_tokens(tokens))
    new = slots.select("conv_id", "template_idx").distinct().join(owners, "conv_id").select(
        "conv_id", "template_idx", creator, "client", F.lit("Suggested").alias("state"))
    old = owners.filter("conv_id % 2 = 0").select("conv_id", F.lit(0).alias("template_idx"), creator,
                                                  F.lit("Confirmed").alias("state"))
    settings = owners.select("client", F.lit("google").alias("type"), F.col("client").alias("name")).distinct().filter(
        "client <> 'o2'")
    routed = q.route_by_creator(q.keep_states(old, new), settings)
    return routed.select("conv_id", "creator", "state", "routed")


@query(f"""WITH {CONV_SQL}, settings AS (SELECT owner AS client, CAST(avg(modified) AS BIGINT) AS changed FROM conv GROUP BY 1),
k AS (SELECT conv_id, owner AS client, greatest(modified, changed) AS date FROM conv JOIN settings ON client = owner)
SELECT conv_id, client, date, conv_id % 2 = 0 AND date > modified AS fresh FROM k JOIN (SELECT conv_id AS c, modified FROM conv)
  ON c = conv_id""")
def fresh_analyses(spark, sf):
    conv = ad.conversations(spark, sf)
    settings = conv.groupBy(F.col("owner").alias("client")).agg(F.timestamp_millis(
        F.round(F.avg(F.unix_millis("last_modified"))).cast("long")).alias("modified"))
    keys = q.analysis_keys(conv, settings)
    stored = keys.join(conv.select("conv_id", "last_modified"), "conv_id").filter(
        "conv_id % 2 = 0 and date > last_modified").drop("last_modified")
    hits, misses = q.fresh_analyses(conv, settings, stored)
    out = hits.withColumn("fresh", F.lit(True)).unionByName(misses.withColumn("fresh", F.lit(False)))
    return out.withColumn("date", F.unix_millis("date"))


def _settings(owners):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("solrsearch", "google", "conversationsearch", "conversationmlt")]))
    return owners.select("client").distinct().select("client", kinds.alias("type")).withColumn(
        "name", F.col("type")).withColumn("enabled", F.col("type") != "google")


@query()
def batch_analyze(spark, sf):
    """Tokens, templates and queries of every conversation in one job."""
    msg = ad.stored(w.analysis_window(ad.messages(spark, sf), WINDOW))
    words = ad.stored(_words(msg))
    spans = ad.stored(words.unionByName(_chunks(msg, words), allowMissingColumns=True).withColumn(
        "phrase", F.lit(None).cast("string")))
    tf, stats = _conversation_terms(spark, sf)
    sizes = stats.groupBy("term").agg(F.sum("df").alias("df"))
    n_docs = ad.conversations(spark, sf).filter("deleted is null").agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = ad.stored(a.keyword_terms(tf.drop("owner"), {"chat": (sizes, n_docs)}))
    vocabulary = ad.stored(_vocabulary(spark, sf, words))
    rules = {"lang": "de", "types": ["Place", "Date"], "rules": [(r"(?:die|the|le) (<Place>)", ["from"])]}
    tokens = ad.stored(a.analyze(msg, spans, _stop(spark), vocabulary, "de", terms, [rules]))
    owners = ad.conversations(spark, sf).select("conv_id", F.col("owner").alias("client"))
    slots = ad.stored(a.build_templates(tokens))
    return q.build_queries(slots, tokens, w.context_start(msg), _settings(owners), owners)


# Rejected tokens (low confidence) take no part in templates; queries of the components that are enabled.
_EDITED_SQL = _windowed(_LATCH_SQL).replace("ELSE 'alphabet' END AS role FROM indexed)", "ELSE 'alphabet' END AS role "
                                            "FROM indexed WHERE confidence >= 0.3)").replace(
    "FROM indexed WHERE type <> 'Topic'", "FROM indexed WHERE type <> 'Topic' AND confidence >= 0.3")


@query(f"""{_EDITED_SQL}{_START_SQL}, {_PHRASES_SQL},
lq AS (SELECT conv_id, string_agg(p, ' OR ' ORDER BY confidence DESC, token_idx, k) AS query FROM two GROUP BY conv_id),
v AS (SELECT conv_id, role, value, min(token_idx) AS first_at FROM rel JOIN starts USING (conv_id)
  WHERE message_idx >= start AND value <> '' GROUP BY ALL),
rq AS (SELECT conv_id, string_agg(value, ' ' ORDER BY role, first_at) AS query FROM v GROUP BY conv_id)
SELECT conv_id, 0 AS template_idx, 'queryBuilder:solrsearch:solrsearch' AS creator, coalesce(query, '') AS query,
  0.8::DOUBLE AS confidence, 'Suggested' AS state FROM (SELECT DISTINCT conv_id FROM latch) LEFT JOIN lq USING (conv_id)
UNION ALL SELECT conv_id, 1, 'queryBuilder:conversationsearch:conversationsearch', coalesce(query, ''), 0.6::DOUBLE, 'Suggested'
FROM (SELECT DISTINCT conv_id FROM rel) LEFT JOIN rq USING (conv_id)""")
def reapply_tokens(spark, sf):
    msg, _, _, tokens = _tokens(spark, sf, WINDOW)
    edited = ad.stored(tokens.withColumn("state", F.when(F.col("confidence") < 0.3, "Rejected").otherwise("Confirmed")))
    owners = ad.conversations(spark, sf).select("conv_id", F.col("owner").alias("client"))
    _, queries = q.reapply_tokens(edited, w.context_start(msg), _settings(owners), owners)
    return queries


_CHAT_TEXTS = [("c1", "en", "thtion that"), ("c2", "fr", "Étion la"), ("c3", "de", "und chkeit")]


def _chat_docs(spark, sf):
    toxic = ad.table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("removed"))
    docs = ad.documents(spark, sf).join(toxic, "doc_id", "left").select(
        F.col("lang").alias("client"), F.concat(F.lit("d"), "doc_id").alias("id"), "text",
        F.coalesce("removed", F.lit(False)).alias("removed"))
    queries = spark.createDataFrame(_CHAT_TEXTS, "query_id string, client string, text string")
    return docs, queries


@query(f"""WITH q(query_id, client, text) AS (VALUES {', '.join(str(t) for t in _CHAT_TEXTS)}),
live AS (SELECT doc_id, lang AS client, concat('d', doc_id) AS id, text, list_filter(regexp_split_to_array(text,
  '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents LEFT JOIN labels USING (doc_id)
  WHERE coalesce(toxic, 0) = 0),
t AS (SELECT client, id, len(ws) AS len, lower(unnest(ws)) AS term FROM live),
tf AS (SELECT client, id, term, any_value(len) AS len, count(*) AS tf FROM t GROUP BY client, id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM live),
c AS (SELECT DISTINCT query_id, client, lower(unnest(regexp_split_to_array(text, '\\s+'))) AS term FROM q)
SELECT query_id, id, round(sum(4 * (1 + ln((n + 1) / (df + 1))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6)
  AS score FROM c JOIN tf USING (client, term) JOIN df USING (term), n GROUP BY query_id, id""")
def search_chat_docs(spark, sf):
    docs, queries = _chat_docs(spark, sf)
    return q.search_chat_docs(docs, queries).select("query_id", "id", "score")


@query(f"""WITH q(query_id, client, text) AS (VALUES {', '.join(str(t) for t in _CHAT_TEXTS)}),
c AS (SELECT query_id, client, list_distinct(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(x))) AS asked FROM q),
live AS (SELECT lang AS client, concat('d', doc_id) AS id, list_filter(regexp_split_to_array(text,
  '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents LEFT JOIN labels USING (doc_id)
  WHERE coalesce(toxic, 0) = 0),
m AS (SELECT query_id, id, i - 1 AS pos, lower(ws[i]) AS term FROM (SELECT query_id, id, asked, ws,
  unnest(range(1, len(ws) + 1)) AS i FROM live JOIN c USING (client)) WHERE list_contains(asked, lower(ws[i]))),
k AS (SELECT query_id, id, count(DISTINCT term) AS k FROM m GROUP BY ALL),
near AS (SELECT e.query_id, e.id, e.pos AS hi, b.term, max(b.pos) AS pos FROM m e JOIN m b
  ON b.query_id = e.query_id AND b.id = e.id AND b.pos <= e.pos GROUP BY ALL),
runs AS (SELECT query_id, id, hi, min(pos) AS lo, count(*) AS held FROM near GROUP BY ALL),
best AS (SELECT query_id, id, lo, hi FROM runs JOIN k USING (query_id, id) WHERE held = k
  QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY hi - lo, hi) = 1)
SELECT query_id, id, lo::INT AS first_word, hi::INT AS last_word, array_to_string(list_transform(
  ws[lo + 1:hi + 1], lambda x: CASE WHEN list_contains(asked, lower(x)) THEN '<em>' || x || '</em>' ELSE x END), ' ')
  AS passage FROM best JOIN c USING (query_id) JOIN live USING (client, id)""")
def chat_passages(spark, sf):
    """The shortest passage of every found document with all words of the query that it has."""
    docs, queries = _chat_docs(spark, sf)
    hits = q.search_chat_docs(docs, queries).select("query_id", "client", "id")
    return q.passages(hits, docs, queries).drop("client")


@query(f"""{_LATCH_SQL}, t AS (SELECT conv_id, 'token' AS part, token_idx AS n, concat(type, ':', value) AS label FROM indexed
  UNION ALL SELECT conv_id, 'template', template_idx, role FROM (SELECT DISTINCT conv_id, template_idx, role FROM rel))
SELECT * FROM t""")
def analysis_parts(spark, sf):
    """The token list of each analysis and its second template."""
    _, _, _, tokens = _tokens(spark, sf)
    indexed = a.index_tokens(tokens)
    slots = f.template_at(a.build_templates(indexed), 1).select("conv_id", "template_idx", "role").distinct()
    listed = indexed.select("conv_id", F.lit("token").alias("part"), F.col("token_idx").alias("n"),
                            F.concat_ws(":", "type", "value").alias("label"))
    return listed.unionByName(slots.select("conv_id", F.lit("template").alias("part"), F.col("template_idx").cast(
        "long").alias("n"), F.col("role").alias("label")))


@query(f"""{_MASK_SQL}, about AS (SELECT DISTINCT conv_id, msg_idx FROM words WHERE length(text) = 10)
SELECT o.conv_id, o.msg_idx AS message_idx, start, type, CASE WHEN type = 'Place' AND a.conv_id IS NOT NULL
  AND regexp_matches(substring(masked, 1, "offset"), '(die|the|le) $') THEN 'from' ELSE '' END AS hints
FROM offs o JOIN full_text USING (conv_id, msg_idx) LEFT JOIN about a ON a.conv_id = o.conv_id AND a.msg_idx = o.msg_idx
WHERE type IS NOT NULL
UNION ALL SELECT conv_id, msg_idx, start, 'Topic', '' FROM words WHERE length(text) = 10""")
def apply_rulesets(spark, sf):
    msg = ad.messages(spark, sf)
    words = _words(msg).filter("length(text) % 6 = 0 or length(text) = 10")
    tokens = words.select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end",
        F.expr("case when length(text) = 10 then 'ReiseplanungBahn' else text end").alias("value"),
        F.expr("case when length(text) = 10 then 'Topic' when length(text) % 4 = 0 then 'Place' else 'Date' end").alias("type"),
        F.array().cast("array<string>").alias("hints"), F.lit(0.5).alias("confidence"))
    travel = {"lang": "de", "topics": ["Reiseplanung"], "types": ["Place", "Date"],
              "rules": [(r"(?:die|the|le) (<Place>)", ["from"])]}
    other = {"lang": "en", "rules": [(r"(<Place>)", ["never"])]}
    return a.apply_rulesets(tokens, _texts(msg), [travel, other], "de").select(
        "conv_id", "message_idx", "start", "type", F.array_join("hints", ",").alias("hints"))
