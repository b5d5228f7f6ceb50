"""Search over a stored index: only the buckets of the terms asked for are read, and no text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.operators.search import DIGITS, bm25, idf, query_clauses
from parley.session import written
from parley.sources.index import Index, bucket, grams


def wildcard_terms(index: Index, clauses: DataFrame) -> DataFrame:
    """(clause, term) of the stored terms that contain the clause; clauses may be any number.

    A term that contains a clause holds all its pieces of three characters (a shorter clause is such a piece itself), so
    the terms of the clause's rarest piece are read and verified.
    """
    pattern = clauses.select("clause").distinct()
    wanted = pattern.select("clause", F.explode(F.when(F.length("clause") < 3, F.array("clause")).otherwise(
        grams(F.col("clause"), 3))).alias("gram"))
    holding = index.gram_terms(wanted)
    counts = holding.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(counts, "gram").groupBy("clause").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    return holding.join(rarest, "gram").filter(F.contains("term", "clause")).select("clause", "term")


def wildcard_match(index: Index, clauses: DataFrame) -> DataFrame:
    """``clauses`` with every stored ``term`` that is equal to them, starts with them, or contains them, by ``mode``."""
    found = wildcard_terms(index, clauses)
    fits = (F.col("mode") == "infix") | ((F.col("mode") == "prefix") & F.startswith("term", "clause")) | (
        (F.col("mode") == "exact") & (F.col("term") == F.col("clause")))
    return clauses.join(found, "clause").filter(fits)


def expanded_clauses(index: Index, queries: DataFrame, wildcards: bool = True) -> DataFrame:
    """Clauses of the queries with the terms they stand for and the terms' buckets.

    The table is written once: the search needs it twice, and its buckets (no more than there are) on the driver.
    """
    clauses = query_clauses(queries)
    terms = clauses.filter(F.col("mode") == "exact").withColumn("term", F.col("clause"))
    if wildcards:
        terms = terms.unionByName(wildcard_match(index, clauses.filter(F.col("mode") != "exact")).select(*terms.columns))
    return written(terms.withColumn("bucket", bucket("term", index.shape.buckets)), "clauses")


def _weights(index: Index, expanded: DataFrame, buckets: list[int]) -> tuple[DataFrame, Column, Column]:
    """(clause, df) of exact clauses, the number of documents, and their mean length."""
    asked = expanded.filter(F.col("mode") == "exact").select("term").distinct()
    df = index.frequencies(buckets).join(asked, "term").groupBy(F.col("term").alias("clause")).agg(
        F.sum("df").alias("df"))
    size = index.sizes().agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return df, size.select("n").scalar(), size.select(F.try_divide("words", "n")).scalar()


def _scored(index: Index, rows: DataFrame, weights: tuple[DataFrame, Column, Column]) -> DataFrame:
    """Score of every document from postings joined with clauses.  Signs are added up here, so a document that has gone
    or changed counts as it is now."""
    frequencies, n_docs, mean = weights
    scope, doc = index.shape.scope, index.shape.doc
    columns = [*dict.fromkeys([*scope, *doc])]
    live = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    found = rows.groupBy("query_id", *columns, "clause", "mode").agg(
        F.sum("sign").alias("_n"), live("tf"), live("len"), F.first("boost").alias("boost")).filter("_n > 0")
    relevance = bm25(F.col("tf"), F.col("len"), mean, idf(n_docs, F.col("df")))
    score = F.when(F.col("mode") == "exact", F.col("boost") * relevance).otherwise(F.col("boost"))
    return (found.join(frequencies, "clause", "left").withColumn("_score", score)
            .groupBy("query_id", *columns).agg(F.round(F.sum("_score"), DIGITS).alias("score")))


def search(index: Index, queries: DataFrame, wildcards: bool = True) -> DataFrame:
    """Hits (query_id, scope, doc, ``score``) as ``search.search`` gives them, from the stored postings.

    ``queries``: query_id, text and the scope.  An exact clause scores boost * BM25, a prefix or infix clause its boost
    once per document.
    """
    expanded = expanded_clauses(index, queries, wildcards)
    buckets = [r.bucket for r in expanded.select("bucket").distinct().collect()]
    matched = index.rows("postings", buckets).join(expanded, [*index.shape.scope, "bucket", "term"])
    return _scored(index, matched, _weights(index, expanded, buckets))


def top_groups(index: Index, queries: DataFrame, groups: int = 10, per_group: int = 1, doc_order: Sequence[str] = ("idx",),
               first_blocks: int = 8, wildcards: bool = True) -> DataFrame:
    """Hits of the best ``groups`` keys of every query, best first, with ``group_rank``; exact, but not all is scored.

    Documents lie in blocks by key.  From the stored bounds of every (term, block) follows what the best document of a
    block can score at most.  The ``first_blocks`` most promising blocks of a query are scored; of the others only those
    whose bound reaches the worst of the best groups found so far.
    """
    key, scope = index.shape.key, list(index.shape.scope)
    expanded = expanded_clauses(index, queries, wildcards)
    buckets = [r.bucket for r in expanded.select("bucket").distinct().collect()]
    weights = _weights(index, expanded, buckets)
    frequencies, n_docs, mean = weights
    most = bm25(F.col("tf"), F.col("len"), mean, idf(n_docs, F.col("df")))
    bound = F.when(F.col("mode") == "exact", F.col("boost") * most).otherwise(F.col("boost"))
    bounds = (index.bounds(buckets).join(expanded, [*scope, "term"]).join(frequencies, "clause", "left")
              .groupBy("query_id", "block", "clause", "mode").agg(F.max(bound).alias("_bound"))
              .groupBy("query_id", "block").agg((F.sum("_bound") + 10.0 ** -DIGITS).alias("_bound")))
    promising = Window.partitionBy("query_id").orderBy(F.desc("_bound"), "block")
    # no more rows than blocks for each query
    bounds = written(bounds.withColumn("_rank", F.row_number().over(promising)), "bounds")
    postings = index.rows("postings", buckets).join(expanded, [*scope, "bucket", "term"])

    def hits(blocks: DataFrame) -> DataFrame:
        return _scored(index, postings.join(blocks.select("query_id", "block"), ["query_id", "block"], "left_semi"), weights)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("_best"), key)
        top = found.groupBy("query_id", key).agg(F.max("score").alias("_best"))
        return top.withColumn("group_rank", F.row_number().over(order)).filter(F.col("group_rank") <= groups)

    early = written(hits(bounds.filter(F.col("_rank") <= first_blocks)), "early")
    reached = best(early).filter(F.col("group_rank") == groups).select("query_id", F.col("_best").alias("_least"))
    later = bounds.filter(F.col("_rank") > first_blocks).join(reached, "query_id", "left").filter(
        F.col("_least").isNull() | (F.col("_bound") >= F.col("_least")))
    found = early.unionByName(hits(later))
    within = Window.partitionBy("query_id", key).orderBy(F.desc("score"), *doc_order)
    return (found.join(best(found).drop("_best"), ["query_id", key]).withColumn("_r", F.row_number().over(within))
            .filter(F.col("_r") <= per_group).drop("_r"))
