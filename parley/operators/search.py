"""Full-text search and similarity in batch: many queries against many documents at once.

Pinned definitions: ``idf = 1 + ln((N + 1) / (df + 1))``, BM25 with k1 = 1.2 and b = 0.75 for search, tf * idf for
similarity.  Scores are rounded to six digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parley.functions.lists import DIGITS, best_of_block
from parley.functions.stemming import analyze_text
from parley.functions.text import bind, escape_query, search_word_terms
from parley.lookup import frequency_join, is_small, lookup_join
from parley.scan import ordinal
from parley.session import cut_lineage, written

K1, B = 1.2, 0.75
# What meets in one task of ``related``.
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 1_000_000, 8192


def idf(n_docs: Column, df: Column) -> Column:
    return F.lit(1.0) + F.log((n_docs + 1) / (df + 1))


def bm25(tf: Column, length: Column, avg_len: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def doc_terms(docs: DataFrame, text: str = "content", chain: str = "standard", stop: list[str] | None = None,
              query_side: bool = False) -> DataFrame:
    """Terms of each document with the document length in words; other columns are kept.

    For the ``standard`` chain a term comes once with its count ``tf``, for the others once per occurrence.
    """
    if chain == "standard" and not stop:
        return _counted(docs, text)
    terms = analyze_text(docs, text, chain, stop, query_side, lengths=True)
    return terms.drop("word", "pos").withColumn("tf", F.lit(1))


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """Lower-case words with their counts, found by sorting the words of the row: nothing is shuffled."""
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")
    # one lower() over all words instead of one per word
    ordered = F.sort_array(F.array_remove(F.split(F.lower(F.array_join(words, " ")), " "), ""))

    def starts(ws: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(ws) - 1)
        changes = F.filter(every, lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        return F.when(F.size(ws) > 0, F.struct(ws.alias("ws"), changes.alias("at")))

    def counts(found: Column) -> Column:
        ws, at = found["ws"], found["at"]
        return F.transform(at, lambda i, n: F.struct(
            F.size(ws).alias("len"), F.get(ws, i).alias("term"),
            (F.coalesce(F.get(at, n + 1), F.size(ws)) - i).cast("long").alias("tf")))

    keep = [c for c in docs.columns if c != text]
    # a column of its own for the array would be found twice, once by the filter that Spark infers from it
    return docs.select(*keep, F.inline(bind(bind(ordered, starts), counts)))


def postings(docs: DataFrame, keys: Sequence[str], text: str = "content", chain: str = "standard",
             stop: list[str] | None = None) -> DataFrame:
    """(keys, term, tf, len) of documents, one row each.

    All terms of a document come from one row.  The ``standard`` chain counts them there; for the others the count is a
    map-side combine.
    """
    terms = doc_terms(docs.select(*keys, text), text, chain, stop)
    if chain == "standard" and not stop:
        return terms.select(*keys, "term", "tf", "len")
    return terms.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def term_stats(tf: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Document frequency per term (and scope) of a table with one row per document and term."""
    return tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def document_frequencies(docs: DataFrame, text: str = "content", scope: Sequence[str] = ()) -> DataFrame:
    """Document frequency per term straight from the texts: each document gives each of its words once, uncounted."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    each = docs.select(*scope, F.explode(F.array_remove(F.array_distinct(words), "")).alias("term"))
    return each.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def query_clauses(queries: DataFrame) -> DataFrame:
    """Clauses (``clause``, ``mode``, ``boost``) of the ``text`` of each query, lower case, each once per query."""
    keep = [c for c in queries.columns if c != "text"]
    return (queries.select(*keep, F.explode(search_word_terms(F.col("text"))).alias("_c"))
            .select(*keep, F.lower("_c.term").alias("clause"), F.col("_c.mode").alias("mode"),
                    F.col("_c.boost").alias("boost")).distinct())


def _grams(term: Column, size: int) -> Column:
    positions = F.when(F.length(term) >= size, F.sequence(F.lit(1), F.length(term) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(positions, lambda i: F.substr(term, i, F.lit(size))))


def wildcard_match(vocabulary: DataFrame, clauses: DataFrame) -> DataFrame:
    """Vocabulary terms matching each clause: equal, starting with it, or containing it.

    ``vocabulary`` holds distinct ``term``s.  Containment is found by an equality join on character trigrams (shorter
    pieces for shorter clauses) and verified, never by a cross product.  A clause is looked up by the one of its
    trigrams that the fewest terms contain.
    """
    pattern = clauses.select("clause").distinct()
    gram_of_terms = vocabulary.select("term", F.explode(F.concat(
        _grams(F.col("term"), 1), _grams(F.col("term"), 2), _grams(F.col("term"), 3))).alias("gram"))
    wanted = pattern.select("clause", F.explode(_grams(F.col("clause"), 3)).alias("gram")).unionByName(
        pattern.filter(F.length("clause") < 3).select("clause", F.col("clause").alias("gram")))
    small = is_small(wanted)
    needed = wanted.select("gram").distinct()
    relevant = gram_of_terms.join(F.broadcast(needed) if small else needed, "gram")
    counts = relevant.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(counts, "gram").groupBy("clause").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    candidates = relevant.join(F.broadcast(rarest) if small else rarest, "gram")
    found = candidates.filter(F.contains("term", "clause")).select(
        "clause", "term", (F.col("term") == F.col("clause")).alias("_exact"),
        F.startswith("term", "clause").alias("_prefix"))
    matched = clauses.join(found, "clause")
    return matched.filter((F.col("mode") == "infix") | ((F.col("mode") == "prefix") & F.col("_prefix"))
                          | F.col("_exact") & (F.col("mode") == "exact")).drop("_exact", "_prefix")


def search(terms: DataFrame, docs: DataFrame, queries: DataFrame, doc_keys: Sequence[str],
           scope: Sequence[str] = (), wildcards: bool = True) -> DataFrame:
    """Hits (query columns, ``doc_keys``, ``score``).

    ``terms``: doc_keys, scope, len, term, tf (counted or one row per occurrence).  ``docs``: one row per document with
    ``len``.  ``queries``: query_id, text and the ``scope`` columns that must equal those of the document.  An exact
    clause scores boost * BM25, a prefix or infix clause its boost once per document.
    """
    scope, doc_keys = list(scope), list(doc_keys)
    clauses = query_clauses(queries)
    if not wildcards:
        clauses = clauses.filter(F.col("mode") == "exact")
    exact = clauses.filter(F.col("mode") == "exact").withColumn("term", F.col("clause"))
    expanded = exact
    if wildcards:
        expanded = wildcard_match(terms.select("term").distinct(), clauses)
    # at most one row per exact clause
    few = is_small(exact)
    asked = exact.select("term").distinct()
    holding = terms.join(F.broadcast(asked) if few else asked, "term")
    if not wildcards:
        # only these terms matter, and they are found once in the texts
        terms = holding = cut_lineage(holding)
    # the size of the expansion is only known at run time; adaptive execution picks the join and splits hot terms
    matched = terms.join(expanded, [*scope, "term"])
    found = matched.groupBy("query_id", *scope, *doc_keys, "clause", "mode").agg(
        F.sum("tf").alias("tf"), F.first("len").alias("len"), F.first("boost").alias("boost"))
    frequencies = holding.groupBy("term").agg(F.count_distinct(*doc_keys).alias("df")).withColumnRenamed(
        "term", "clause")
    corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    weighted = found.join(F.broadcast(frequencies) if few else frequencies, "clause", "left")
    n_docs, avg_len = corpus.select("n").scalar(), corpus.select("avg_len").scalar()
    relevance = bm25(F.col("tf"), F.col("len"), avg_len, idf(n_docs, F.col("df")))
    clause_score = F.when(F.col("mode") == "exact", F.col("boost") * relevance).otherwise(F.col("boost"))
    return (weighted.withColumn("_score", clause_score)
            .groupBy("query_id", *scope, *doc_keys).agg(F.round(F.sum("_score"), DIGITS).alias("score")))


def group_hits(hits: DataFrame, group: str = "conv_id", doc_order: Sequence[str] = ("idx",), per_group: int = 1,
               groups: int | None = 10, query_id: str = "query_id") -> DataFrame:
    """Hits of the best ``groups`` groups per query, at most ``per_group`` each, with ``group_rank`` and the total
    number of groups ``num_found``."""
    ranked_docs = Window.partitionBy(query_id, group).orderBy(F.desc("score"), *doc_order)
    best = hits.groupBy(query_id, group).agg(F.max("score").alias("_best"))
    found = best.groupBy(query_id).agg(F.count(F.lit(1)).alias("num_found"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("_best"), group))
    top = best.withColumn("group_rank", rank)
    if groups is not None:
        top = top.filter(F.col("group_rank") <= groups)
    top = top.join(found, query_id).drop("_best")
    kept = hits.join(top, [query_id, group]).withColumn("_r", F.row_number().over(ranked_docs))
    return kept.filter(F.col("_r") <= per_group).drop("_r")


def hydrate_hits(hits: DataFrame, conv: DataFrame) -> DataFrame:
    """Hits with the columns of their conversation; hits of missing or deleted conversations are dropped."""
    return hits.join(conv.filter(F.col("deleted").isNull()), "conv_id")


def hits_to_messages(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per message behind each hit: a merged document stands for several messages."""
    covered = docs.select("conv_id", "idx", "message_idxs")
    return hits.join(covered, ["conv_id", "idx"]).drop("idx").withColumn("idx", F.explode("message_idxs")).drop(
        "message_idxs")


def paged_hits(hits: DataFrame, order: Sequence[Column], number: int = 0, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """One page (numbered from 0) of the hits of every query with their ``rank`` from 1, and (query_id, num_found)."""
    best = Window.partitionBy("query_id").orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= (number + 1) * size).filter(F.col("rank") > number * size)
    return ranked, hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_found"))


def copy_fields(docs: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add search fields that collect the texts of other columns (target -> source columns or prefixes ending in *), in
    the order of the rules."""
    for target, sources in rules.items():
        columns = dict.fromkeys(c for rule in sources for c in docs.columns if c == rule or (
            rule.endswith("*") and c.startswith(rule[:-1]) and c != target))
        docs = docs.withColumn(target, F.concat_ws("\n", *columns))
    return docs


def facet_counts(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts per value of each field in one pass (``field``, ``value``, ``n``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                                for f in fields]))
    return (docs.select(pairs.alias("_p")).select("_p.*").filter(F.col("value").isNotNull())
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))


def interesting_terms(tf: DataFrame, stats: DataFrame, n_docs: Column, key: Sequence[str],
                      scope: Sequence[str] = (), max_terms: int = 20, min_len: int = 3, min_df: int = 1,
                      min_tf: int = 1) -> DataFrame:
    """Best terms of each text by tf * idf against a corpus, with the weight also as share of the best one.

    ``tf``: key, scope, term, tf.  ``stats``: scope, term, df.  ``n_docs``: size of the corpus (of the scope).
    """
    usable = tf.filter((F.length("term") >= min_len) & (F.col("tf") >= min_tf))
    known = stats.filter(F.col("df") >= min_df)
    weighted = frequency_join(usable, known, [*scope, "term"], "df").withColumn(
        "weight", F.round(F.col("tf") * idf(n_docs, F.col("df")), DIGITS))
    window = Window.partitionBy(*key).orderBy(F.desc("weight"), "term")
    best = weighted.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= max_terms)
    top = Window.partitionBy(*key)
    return best.withColumn("boost", F.col("weight") / F.max("weight").over(top))


def similarity_query(terms: DataFrame, key: Sequence[str]) -> DataFrame:
    """``term OR term^boost OR ...`` by falling weight; the best term carries no boost."""
    clause = F.when(F.col("rank") == 1, escape_query(F.col("term"))).otherwise(F.concat(
        escape_query(F.col("term")), F.lit("^"), F.format_number(F.col("boost"), 4)))
    clauses = F.array_sort(F.collect_list(F.struct("rank", clause.alias("clause"))))
    return terms.groupBy(*key).agg(
        F.array_join(F.transform(clauses, lambda c: c["clause"]), " OR ").alias("similarity_query"))


def fallback_query(user_query: Column, alternative: Column) -> Column:
    """The alternative is used when the user gave no terms."""
    return F.when(F.coalesce(F.trim(user_query) != "", F.lit(False)), user_query).otherwise(alternative)


def _one_per_copy(tf: DataFrame, docs: DataFrame, scope: list[str], doc: str, keep: int) -> DataFrame:
    """Documents (scope, doc, votes, ``_terms``: their terms and counts): of those with the very same terms only the
    ``keep`` best can be among the best of any query."""
    packed = tf.groupBy(*scope, doc).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("_terms"))
    order = Window.partitionBy(*scope, "_copy").orderBy(F.desc("votes"), doc)
    return (packed.withColumn("_copy", F.sha2(F.to_json("_terms"), 256))
            .join(docs.select(*scope, doc, "votes"), [*scope, doc])
            .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_copy", "_n"))


def related(queries: DataFrame, tf: DataFrame, docs: DataFrame, stats: DataFrame, n_docs: Column,
            scope: Sequence[str], doc: str, rows: int = 3, exclude_self: bool = True, light_df: int = 10_000,
            depth: int = 998, start: int = 0) -> DataFrame:
    """The ``rows`` best documents per query, after the first ``start``, by the sum of boost * tf * idf, then votes,
    then id.

    ``queries``: ``doc`` (the asking conversation), scope, term, boost (a handful of terms each).  ``tf``: doc, scope,
    term, tf.  ``docs``: doc, scope, votes.  ``stats``: term, df, and the scope columns that they depend on.

    The result is exact and no pair of a query and a document is shuffled.  Equal queries are answered once; of equal
    documents only the best few take part.  The documents of a scope are dealt out to blocks, its queries too, and each
    block of queries meets each block of documents in a task, which gives the best few of the block for each query.  There
    documents are found through terms with at most ``light_df`` documents and through the first ``depth`` entries of the
    lists of more frequent terms, sorted by weight.  A query whose last result beats everything still unread in its lists
    is done; the others read on, eight times as deep.
    """
    scope = list(scope)
    wanted = start + rows + (1 if exclude_self else 0)
    signature = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", "boost")))), 256)
    asked = queries.groupBy(*scope, doc).agg(signature.alias("_q"))
    distinct = (queries.join(asked, [*scope, doc]).groupBy(*scope, "_q", "term")
                .agg(F.first("boost").alias("boost")))
    # the frequencies go to the few terms of the queries, not to all terms of the documents
    known = frequency_join(distinct, stats, [c for c in (*scope, "term") if c in stats.columns], "df")
    entry = F.struct("term", F.col("boost").cast("double").alias("boost"), idf(n_docs, F.col("df")).alias("idf"),
                     (F.col("df") > light_df).alias("heavy"))
    asking = written(known.groupBy(*scope, "_q").agg(F.collect_list(entry).alias("_terms")), "asking")
    texts = written(_one_per_copy(tf, docs, scope, doc, wanted), "texts")
    best = Window.partitionBy(*scope, "_q").orderBy(F.desc("score"), F.desc("votes"), doc)
    answers = _met_in_blocks(asking, texts, scope, doc, wanted, depth).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= wanted)
    result = asked.withColumnRenamed(doc, "query_id").join(answers, [*scope, "_q"]).drop("_q", "rank")
    if exclude_self:
        result = result.filter(F.col("query_id") != F.col(doc))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("votes"), doc)
    ranked = result.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= start + rows)
    return ranked.filter(F.col("rank") > start) if start else ranked


def _met_in_blocks(asking: DataFrame, texts: DataFrame, scope: list[str], doc: str, wanted: int, depth: int) -> DataFrame:
    """The ``wanted`` best documents (scope, _q, doc, score, votes) of every block of documents for each query.

    Scopes that fit one block share a task with others.
    """
    parts = lambda rows, most: F.ceil(F.col(rows) / most)
    held = texts.groupBy(*scope).agg(F.count(F.lit(1)).alias("_docs"), F.sum(F.size("_terms")).alias("_entries"))
    sizes = held.join(asking.groupBy(*scope).agg(F.count(F.lit(1)).alias("_queries")), scope)
    sizes = written(sizes.withColumns({
        "_nd": F.greatest(parts("_docs", BLOCK_DOCS), parts("_entries", BLOCK_ENTRIES)),
        "_nq": parts("_queries", BLOCK_QUERIES)}), "sizes")
    single = (F.col("_nd") == 1) & (F.col("_nq") == 1)
    total = sizes.filter(single).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "_docs", "_entries", "_queries")]).first()
    bins = 1 + max(total["_docs"] // BLOCK_DOCS, total["_entries"] // BLOCK_ENTRIES, total["_queries"] // BLOCK_QUERIES)
    own = F.xxhash64(*scope)

    def dealt(rows: DataFrame, key: str, mine: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        placed = sizes.select(*scope, "_nd", "_nq", F.when(single, F.pmod(own, F.lit(bins))).otherwise(own).alias("_bin"))
        joined = lookup_join(rows, placed, scope)
        return (joined.withColumn(mine[0], F.pmod(F.xxhash64(key), F.col(mine[1])))
                .withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1)))
                .drop("_nd", "_nq"))

    cell = ["_bin", "_db", "_qb"]
    left = dealt(asking, "_q", ("_qb", "_nq"), ("_db", "_nd")).groupBy(*cell)
    right = dealt(texts, doc, ("_db", "_nd"), ("_qb", "_nq")).groupBy(*cell)
    fields = [*[asking.schema[c] for c in (*scope, "_q")], texts.schema[doc], T.StructField("score", T.DoubleType()),
              texts.schema["votes"]]

    def best(queries: pa.Table, documents: pa.Table) -> pa.Table:
        return best_of_block(queries, documents, scope, doc, wanted, depth)

    return left.cogroup(right).applyInArrow(best, T.StructType(fields))


def related_answers(questions: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Later documents (a message position >= 1) of each hit's conversation, ranked by time; all, or ``limit`` per hit."""
    later = docs.filter(F.exists("message_idxs", lambda i: i >= 1)).select(
        "conv_id", F.col("idx").alias("answer_idx"), F.col("time").alias("answer_time"),
        F.col("content").alias("answer"))
    # the order within a conversation is the same for every question, so it is found before the join, hour by hour
    hour = F.coalesce(F.floor(F.unix_seconds("answer_time") / 3600).cast("long"), F.lit(-1 << 62))
    later = ordinal(later.withColumn("_hour", hour), ["conv_id"], [F.col("answer_time"), F.col("answer_idx")], "_hour",
                    "answer_rank").withColumn("answer_rank", F.col("answer_rank").cast("int")).drop("_hour")
    if limit is not None:
        later = later.filter(F.col("answer_rank") <= limit)
    return questions.join(later, "conv_id")


def term_to_surface(terms: DataFrame, analyzed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first word of the text that gave each term; terms without one are dropped."""
    words = analyzed.groupBy(*key, "term").agg(F.min_by("word", "_at").alias("word"))
    return terms.join(words, [*key, "term"])
