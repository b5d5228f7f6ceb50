"""Scalar functions and text analysis over table columns."""

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import EVM_SQL, MSG_SQL
from parley.functions import stemming as st
from parley.functions import text as tx
from parley.functions import values as v
from parley.operators import annotate as a
from parley.operators import search as s
from parley.plans.registry import query
from parley.plans.retrieval import _CONV_TERMS_SQL, _CORPUS_SQL, _conversation_interests

_ESCAPE_SQL = "regexp_replace({}, '([\\\\+\\-!():^\\[\\]\"{{}}~*?|&;/\\s])', '\\\\\\1', 'g')"


@query("""WITH d AS (SELECT doc_id, regexp_split_to_array(replace(text, ', ', ' ``` '), '\\s*`{3,}\\s*') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 THEN concat(x, CASE WHEN i < len(p)
  AND regexp_matches(x, '\\p{L}$') THEN '.' ELSE '' END) WHEN i < len(p) THEN concat(chr(10), chr(10)) ELSE '' END), '')
  AS text FROM d""")
def strip_code_blocks(spark, sf):
    fenced = F.replace(F.col("text"), F.lit(", "), F.lit(" ``` "))
    return ad.documents(spark, sf).select("doc_id", tx.strip_code_blocks(fenced).alias("text"))


_HTML_SQL = """regexp_replace(regexp_replace({}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->',
  ' ', 'g'), '(?s)</?[a-zA-Z!][^>]*>', ' ', 'g')"""
_STRIP_SQL = _HTML_SQL.format("html")
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIP_SQL = f"replace({_STRIP_SQL}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, {_STRIP_SQL} AS text FROM pages")
def strip_html(spark, sf):
    return ad.pages(spark, sf).select("page_id", tx.strip_html(F.col("html")).alias("text"))


# White-space tokens of the pages, which mix punctuation, digits and cases; one token per text and position.
_TOKENS_SQL = f"""t AS (SELECT DISTINCT unnest(regexp_split_to_array({_STRIP_SQL}, '\\s+')) AS token FROM pages
  UNION SELECT DISTINCT concat(p_name, '-', p_brand, 'x', p_size, 'Wi-Fi') FROM part)"""


def _page_tokens(spark, sf):
    pages = ad.pages(spark, sf).select(F.explode(F.split(tx.strip_html(F.col("html")), r"\s+")).alias("token"))
    part = ad.table(spark, sf, "part").select(F.expr("concat(p_name, '-', p_brand, 'x', p_size, 'Wi-Fi')").alias("token"))
    return pages.union(part).distinct()


@query(f"""WITH {_TOKENS_SQL}, j AS (SELECT token, regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS joined FROM t)
SELECT token, array_to_string(list_sort(list_filter(list_distinct(list_concat([token], regexp_extract_all(token,
  '\\p{{Lu}}+[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]*|[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]+|\\p{{N}}+'),
  regexp_extract_all(joined, '\\p{{L}}+|\\p{{N}}+'), [joined])), lambda x: x <> '')), ' ') AS variants FROM j
  WHERE token <> ''""")
def word_delimit(spark, sf):
    tokens = _page_tokens(spark, sf).filter("token <> ''")
    return tokens.select("token", F.array_join(F.array_sort(tx.word_delimit(F.col("token"))), " ").alias("variants"))


_FOLD_SQL = "replace(strip_accents(replace({}, 'ß', 'ss')), 'ẞ', 'SS')"
_PUNCT_SQL = "regexp_replace({}, '(^[,;\"''´`]+)|([!?.,;\"''´`]+$)', '', 'g')"


@query(f"""WITH {_TOKENS_SQL} SELECT token, {_PUNCT_SQL.format('token')} AS bare,
  lower({_FOLD_SQL.format('token')}) AS folded, regexp_matches(token, '[\\p{{L}}\\p{{Nd}}]') AS word,
  regexp_matches(token, '\\p{{Lu}}') AND NOT regexp_matches(token, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]') AS upper_case
FROM t""")
def token_forms(spark, sf):
    token = F.col("token")
    return _page_tokens(spark, sf).select(
        "token", tx.strip_punct(token).alias("bare"), F.lower(tx.ascii_fold(token)).alias("folded"),
        tx.has_letter_or_digit(token).alias("word"), tx.is_all_upper(token).alias("upper_case"))


_TERMS_SQL = """terms AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'))) AS term
  FROM documents)"""


def _light_sql(term):
    plain = f"replace(strip_accents(replace({term}, 'ß', chr(1))), chr(1), 'ß')"
    first = f"regexp_replace({plain}, '^(.{{3,}}?)(?:ern|e[mnrs]|e)$|^(.{{2,}}[bdfghklmnt])s$', '\\1\\2')"
    return f"regexp_replace({first}, '^(.{{3,}})(?:est|e[rn])$|^(.{{2,}}[bdfghklmnt])st$', '\\1\\2')"


_NORM_SQL = ("translate(regexp_replace(regexp_replace(replace({0}, 'ß', 'ss'), '([ao])e', '\\1', 'g'), "
             "'(^|[^aeiouqyäöü])ue', '\\1u', 'g'), 'äöü', 'aou')")


@query(f"""WITH {_TERMS_SQL} SELECT term, {_light_sql('term')} AS light, {_NORM_SQL.format('term')} AS normal,
  CASE WHEN length(term) < 5 THEN term ELSE regexp_replace(translate(term, 'äöü', 'aou'),
    '^(.{{4,}})nen$|^(.{{4,}})(?:en|se|es|er)$|^(.{{4,}})[nesr]$', '\\1\\2\\3') END AS minimal FROM terms""")
def german_stems(spark, sf):
    terms = ad.documents(spark, sf).select(F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("t")).select(
        F.lower("t").alias("term")).distinct()
    term = F.col("term")
    return terms.select("term", st.light_stem_de(term).alias("light"), st.german_normalize(term).alias("normal"),
                        st.minimal_stem_de(term).alias("minimal"))


@query()
def snowball_and_porter_stems(spark, sf):
    terms = ad.documents(spark, sf).select(F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("t")).select(
        F.lower("t").alias("term")).distinct()
    return terms.select("term", st.snowball_de(F.col("term")).alias("german"), st.porter_en(F.col("term")).alias(
        "english"))


@query(f"""WITH w AS (SELECT page_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT page_id,
  regexp_split_to_array({_STRIP_SQL}, '\\s+') AS ws FROM pages))
SELECT page_id, CAST(pos AS INTEGER) AS pos, word, {_FOLD_SQL.format('lower(word)')} AS term FROM w WHERE word <> ''""")
def analyze_text_ws_lower(spark, sf):
    pages = ad.pages(spark, sf).select("page_id", "html")
    return st.analyze_text(pages, "html", "text_ws_lower")


_STOPPED = ["und", "die", "der", "the", "and", "et"]
_STOP_LIST = ", ".join(f"'{word}'" for word in _STOPPED)


@query(f"""WITH w AS (SELECT page_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT page_id,
  regexp_split_to_array({_STRIP_SQL}, '\\s+') AS ws FROM pages)),
j AS (SELECT *, regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS joined FROM w WHERE word <> ''),
x AS (SELECT page_id, pos, unnest(list_filter(list_concat([word], regexp_extract_all(word,
  '\\p{{Lu}}+[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]*|[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]+|\\p{{N}}+'),
  regexp_extract_all(joined, '\\p{{L}}+|\\p{{N}}+'), [joined]), lambda y: y <> '')) AS var FROM j),
b AS (SELECT page_id, pos, lower({_PUNCT_SQL.format('var')}) AS bare FROM x),
f AS (SELECT DISTINCT page_id, pos, {_FOLD_SQL.format(_NORM_SQL.format(_light_sql('bare')))} AS term FROM b
  WHERE bare NOT IN ({_STOP_LIST}))
SELECT page_id, CAST(pos AS INTEGER) AS pos, term FROM f WHERE term <> ''""")
def analyze_text_de(spark, sf):
    pages = ad.pages(spark, sf).select("page_id", "html")
    return st.analyze_text(pages, "html", "text_de", _STOPPED).drop("word")


_DELIMITED_SQL = f"""w AS (SELECT page_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT page_id,
  regexp_split_to_array({_STRIP_SQL}, '\\s+') AS ws FROM pages)),
j AS (SELECT *, regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS joined FROM w WHERE word <> ''),
x AS (SELECT page_id, pos, unnest(list_distinct(list_filter(list_concat([word], regexp_extract_all(word,
  '\\p{{Lu}}+[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]*|[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]+|\\p{{N}}+'),
  regexp_extract_all(joined, '\\p{{L}}+|\\p{{N}}+'), [joined]), lambda y: y <> ''))) AS var FROM j)"""


@query(f"""WITH {_DELIMITED_SQL}, f AS (SELECT DISTINCT page_id, pos, {_FOLD_SQL.format(f"lower({_PUNCT_SQL.format('var')})")}
  AS term FROM x) SELECT page_id, CAST(pos AS INTEGER) AS pos, term FROM f WHERE term <> ''""")
def analyze_text_gen(spark, sf):
    pages = ad.pages(spark, sf).select("page_id", "html")
    return st.analyze_text(pages, "html", "text_gen").drop("word")


@query(f"""WITH {_DELIMITED_SQL}, f AS (SELECT page_id, pos, {_FOLD_SQL.format('lower(var)')} AS term FROM x
  WHERE lower(var) NOT IN ({_STOP_LIST}))
SELECT page_id, CAST(pos AS INTEGER) AS pos, term FROM f WHERE term <> ''""")
def analyze_text_general(spark, sf):
    pages = ad.pages(spark, sf).select("page_id", "html")
    return st.analyze_text(pages, "html", "text_general", _STOPPED).drop("word")


@query()
def analyze_text_en(spark, sf):
    docs = ad.documents(spark, sf).filter("lang = 'en'").select("doc_id", "text")
    return st.analyze_text(docs, "text", "text_en", _STOPPED).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query()
def analyze_text_iterms_de(spark, sf):
    docs = ad.documents(spark, sf).filter("lang = 'de'").select("doc_id", "text")
    return st.analyze_text(docs, "text", "text_iterms_de", _STOPPED).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'))) AS term FROM documents),
m(term, repl) AS (VALUES ('und', 'et'), ('und', 'and'), ('the', 'die'))
SELECT doc_id, coalesce(repl, t.term) AS term, count(*) AS n FROM t LEFT JOIN m USING (term) WHERE t.term <> ''
GROUP BY ALL""")
def synonym_map(spark, sf):
    terms = st.analyze_text(ad.documents(spark, sf).select("doc_id", "text"), "text").select("doc_id", "term")
    synonyms = spark.createDataFrame([("und", "et"), ("und", "and"), ("the", "die")], "term string, replacement string")
    return st.synonym_map(terms, synonyms).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'))) AS term FROM documents),
m(term, repl) AS (VALUES ('und', 'and'), ('the', 'die'))
SELECT doc_id, coalesce(repl, t.term) AS term, count(*) AS n FROM t LEFT JOIN m USING (term) WHERE t.term <> ''
GROUP BY ALL""")
def synonym_map_first(spark, sf):
    """Without expansion a term has one replacement, the first in order."""
    terms = st.analyze_text(ad.documents(spark, sf).select("doc_id", "text"), "text").select("doc_id", "term")
    synonyms = spark.createDataFrame([("und", "et"), ("und", "and"), ("the", "die")], "term string, replacement string")
    return st.synonym_map(terms, synonyms, expand=False).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, ' ? ' UNION ALL SELECT -2, '  '),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]'))
  AS ts, text FROM s)
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN NULL WHEN len(ts) = 0 THEN {_ESCAPE_SQL.format('text')}
  ELSE array_to_string(list_transform(ts, lambda t: concat({_ESCAPE_SQL.format('t')}, '^4',
    CASE WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN '' ELSE concat(
      CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]$') THEN concat(' ', {_ESCAPE_SQL.format('t')}, '*^2') ELSE '' END,
      CASE WHEN regexp_matches(t, '^[\\p{{L}}\\p{{Nd}}]+$') THEN concat(' *', t, '*') ELSE '' END) END)), ' ') END AS q
FROM tok""")
def search_word_query(spark, sf):
    texts = ad.documents(spark, sf).select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, " ? "), (-2, "  ")], "doc_id long, text string"))
    return texts.select("doc_id", tx.search_word_query(F.col("text")).alias("q"))


@query(f"SELECT page_id, {_ESCAPE_SQL.format('url')} AS escaped, md5({_ESCAPE_SQL.format('html')}) AS body FROM pages")
def escape_query(spark, sf):
    return ad.pages(spark, sf).select("page_id", tx.escape_query(F.col("url")).alias("escaped"),
                                               F.md5(tx.escape_query(F.col("html"))).alias("body"))


@query("""SELECT doc_id, lower(regexp_replace(strip_accents(regexp_replace(text, '\\s', '-', 'g')), '[^A-Za-z0-9_-]', '', 'g'))
AS slug FROM documents""")
def to_slug(spark, sf):
    return ad.documents(spark, sf).select("doc_id", tx.to_slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, ltrim(sha256(text), '0') AS digest FROM documents")
def sha256_hex(spark, sf):
    return ad.documents(spark, sf).select("doc_id", tx.sha256_hex(F.col("text")).alias("digest"))


_GRAINS_SQL = "['millisecond', 'second', 'minute', 'hour', 'day', 'week', 'month', 'year']"


@query(f"""WITH e AS (SELECT event_id, ts, list_extract({_GRAINS_SQL}, event_id % 9 + 1) AS grain FROM events),
r AS (SELECT event_id, grain, CASE WHEN grain IS NULL THEN ts ELSE date_trunc(grain, ts) END AS s, ts FROM e)
SELECT event_id, epoch_us(s) AS start_us, epoch_us(CASE grain WHEN 'millisecond' THEN s + INTERVAL 1 MILLISECOND
  WHEN 'second' THEN s + INTERVAL 1 SECOND WHEN 'minute' THEN s + INTERVAL 1 MINUTE WHEN 'hour' THEN s + INTERVAL 1 HOUR
  WHEN 'day' THEN s + INTERVAL 1 DAY WHEN 'week' THEN s + INTERVAL 7 DAY WHEN 'month' THEN s + INTERVAL 1 MONTH
  WHEN 'year' THEN s + INTERVAL 1 YEAR ELSE s END) AS end_us,
  epoch_us(CASE WHEN grain IN ('day', 'week', 'month', 'year') THEN date_trunc('day', ts) + INTERVAL 30600 SECOND ELSE ts END)
  AS default_us FROM r""")
def date_range(spark, sf):
    grains = F.array(*[F.lit(g) for g in v.GRAINS])
    events = ad.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.get(grains, F.expr("cast(event_id % 9 as int)")).alias("grain"))
    span = v.date_range(F.col("ts"), F.col("grain"))
    return events.select("event_id", F.unix_micros(span["start"]).alias("start_us"),
                         F.unix_micros(span["end"]).alias("end_us"),
                         F.unix_micros(v.date_with_default_time(F.col("ts"), F.col("grain"), F.lit(30600))).alias(
                             "default_us"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS us FROM events""")
def to_ts(spark, sf):
    text = F.when(F.expr("event_id % 3 = 0"), F.concat(F.lit("at "), F.col("ts").cast("string"))).otherwise(
        F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")))
    return ad.table(spark, sf, "events").select("event_id", F.unix_micros(v.to_ts(text)).alias("us"))


@query("""SELECT event_id, least(greatest(value / 20 - 0.2, 0), 1) AS share,
  CASE WHEN event_id % 2 = 0 THEN event_type = 'click' END AS private,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS INTEGER) END AS votes,
  CASE WHEN event_id % 5 = 0 THEN 1704067200000 + event_id END AS t FROM events""")
def coerce_message_field(spark, sf):
    click = F.when(F.col("event_type") == "click", "True").otherwise("no")
    votes = F.when(F.expr("event_id % 3 = 0"), F.col("event_id").cast("string")).otherwise(F.col("props"))
    time = F.when(F.expr("event_id % 5 = 0"), F.expr("cast(1704067200000 + event_id as string)")).otherwise(
        F.col("event_type"))
    return ad.table(spark, sf, "events").select(
        "event_id", v.clamp01(F.col("value") / 20 - 0.2).alias("share"),
        v.coerce_message_field("private", F.when(F.expr("event_id % 2 = 0"), click)).alias("private"),
        v.coerce_message_field("votes", votes).alias("votes"),
        F.unix_millis(v.coerce_message_field("time", time)).alias("t"))


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 'mlt_de' WHEN 'en' THEN 'mlt_en' ELSE 'mlt' END AS field,
  coalesce(CASE WHEN doc_id % 2 = 0 THEN 'client' END, CASE WHEN doc_id % 3 = 0 THEN 'conf' END, lang) AS language
FROM documents""")
def language_fallback(spark, sf):
    fields = F.create_map(*[F.lit(x) for x in ("de", "mlt_de", "en", "mlt_en", "default", "mlt")])
    tagged = F.when(F.expr("doc_id % 2 = 0"), F.concat(F.upper("lang"), F.lit("-XX"))).otherwise(F.col("lang"))
    return ad.documents(spark, sf).select(
        "doc_id", v.language_fallback(tagged, fields).alias("field"),
        v.content_language(F.expr("case when doc_id % 2 = 0 then 'client' end"),
                           F.expr("case when doc_id % 3 = 0 then 'conf' end"), F.col("lang")).alias("language"))


@query(f"""SELECT p_partkey, concat('title:"', {_ESCAPE_SQL.format("concat(p_name, ' ', p_brand)")}, '"^',
  CAST(CAST(p_size / 100.0 AS FLOAT) * 3::FLOAT AS FLOAT)) AS phrase FROM part""")
def phrase_query(spark, sf):
    return ad.table(spark, sf, "part").select("p_partkey", v.phrase_query(
        F.concat_ws(" ", "p_name", "p_brand"), F.lit("title"), F.expr("p_size / 100.0"), 3.0).alias("phrase"))


@query("""SELECT p_partkey, concat('"', replace(p_name, '"', ''), '" "', p_brand, '" "', p_name, '"') AS quoted,
  array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]),
    lambda z: z[1]), ' ') AS words FROM (SELECT *, string_split(lower(concat(p_name, ' ', p_brand, ' ', p_name)), ' ') AS ws
  FROM part)""")
def quote_terms(spark, sf):
    terms = F.array(F.concat(F.lit('\\"'), "p_name"), F.col("p_brand"), F.col("p_name"))
    plain = F.array("p_name", "p_brand", "p_name")
    return ad.table(spark, sf, "part").select("p_partkey", tx.quote_terms(terms).alias("quoted"),
                                              tx.dedupe_terms(plain).alias("words"))


@query(f"""WITH {MSG_SQL} SELECT conv_id, md5(string_agg(content, concat(chr(10), chr(10)) ORDER BY idx)) AS everything,
  md5(coalesce(string_agg(content, concat(chr(10), chr(10)) ORDER BY idx) FILTER (NOT skip), '')) AS analysed
FROM msg GROUP BY conv_id""")
def context_text(spark, sf):
    from parley.operators.windows import skips

    recent = ad.messages(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("idx", "content", skips().alias("skip")))).alias("m"))
    return recent.select("conv_id", F.md5(tx.context_text(F.col("m"), True)).alias("everything"),
                         F.md5(tx.context_text(F.col("m"))).alias("analysed"))


@query("""SELECT doc_id, md5(regexp_replace(concat(' ', regexp_replace(text, '([^\\p{L}\\p{N}])', ' \\1 ', 'g'), ' '),
  '(?i) (the|und) ', ' <em>\\1</em> ', 'g')) AS marked FROM documents""")
def highlight(spark, sf):
    spaced = F.concat(F.lit(" "), F.regexp_replace("text", r"([^\p{L}\p{N}])", " $1 "), F.lit(" "))
    return ad.documents(spark, sf).select("doc_id", F.md5(tx.highlight(
        spaced, F.array(F.lit("the"), F.lit("und")))).alias("marked"))


@query(f"""WITH {EVM_SQL}, p AS (SELECT conv_id, user_id, avg(least(votes, 100) / 200.0) AS prob FROM msg GROUP BY ALL)
SELECT conv_id, round(list_reduce(list(prob ORDER BY user_id), lambda x, y: (x + y) / (1 + x * y), 0.0::DOUBLE), 6) AS confidence
FROM p GROUP BY conv_id""")
def sum_probability(spark, sf):
    shares = ad.event_messages(spark, sf).groupBy("conv_id", "user_id").agg(
        F.avg(F.least("votes", F.lit(100)) / 200.0).alias("prob"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("user_id", "prob"))), lambda p: p["prob"])
    return shares.groupBy("conv_id").agg(F.round(v.fold_probability(ordered), 6).alias("confidence"))


@query(f"""WITH {_CONV_TERMS_SQL.replace('ktf AS', 'ktf0 AS', 1).replace('kdf AS', 'ktf AS (SELECT * FROM ktf0), kdf AS', 1)},
{_CORPUS_SQL.replace('ct AS', 'dt AS', 1).replace('FROM ct GROUP', 'FROM dt GROUP')},
own AS (SELECT conv_id, term, 'chat' AS source, round(weight / max(weight) OVER (PARTITION BY conv_id), 6) AS prob
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, term) AS r FROM (
    SELECT conv_id, term, round(sum(tf) * (1 + ln((max(nn) + 1) / (max(dd) + 1))), 6) AS weight FROM ktf
      JOIN (SELECT term, sum(df) AS dd FROM kdf GROUP BY term) USING (term), (SELECT count(*) AS nn FROM conv
        WHERE deleted IS NULL) GROUP BY conv_id, term) WHERE length(term) >= 3) WHERE r <= 20),
doc AS (SELECT conv_id, term, 'docs' AS source, round(weight / max(weight) OVER (PARTITION BY conv_id), 6) AS prob
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, term) AS r FROM (
    SELECT conv_id, term, round(tf * (1 + ln((n + 1) / (df + 1))), 6) AS weight FROM ktf JOIN cdf USING (term), cn)
    WHERE length(term) >= 3) WHERE r <= 20)
SELECT * FROM own UNION ALL SELECT * FROM doc""")
def keyword_terms_by_source(spark, sf):
    from parley.plans.retrieval import _conversation_terms

    tf, stats = _conversation_terms(spark, sf)
    tf = ad.stored(tf.drop("owner"))
    docs = ad.documents(spark, sf)
    own = ad.stored(stats.groupBy("term").agg(F.sum("df").alias("df")))
    n_own = ad.conversations(spark, sf).filter("deleted is null").agg(F.count(F.lit(1)).alias("n")).scalar()
    other = ad.stored(s.term_stats(s.postings(docs, ["doc_id"], "text")))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = a.keyword_terms(tf, {"chat": (own, n_own), "docs": (other, n_docs)})
    return found.withColumn("prob", F.round("prob", 6))


@query(f"""WITH {_CONV_TERMS_SQL}, b AS (SELECT *, weight / max(weight) OVER (PARTITION BY conv_id) AS boost FROM it
  WHERE rank <= 10), q AS (SELECT conv_id, string_agg(CASE WHEN rank = 1 THEN term ELSE concat(term, '^',
  printf('%.4f', boost)) END, ' OR ' ORDER BY rank) AS alt FROM b GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN concat('user', conv_id) ELSE alt END AS q FROM q""")
def fallback_query(spark, sf):
    built = s.similarity_query(_conversation_interests(spark, sf), ["conv_id"])
    user = F.expr("case when conv_id % 2 = 0 then concat('user', conv_id) when conv_id % 3 = 0 then ' ' end")
    return built.select("conv_id", s.fallback_query(user, F.col("similarity_query")).alias("q"))


