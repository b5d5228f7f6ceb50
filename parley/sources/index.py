"""The search index: documents, and their postings as signed changes.

An index is a folder of Parquet tables written by Spark, partitioned by batch and by a bucket of what they are looked up
by, so that a reader opens only the buckets it asks for:

    docs      documents as given, by key; the newest batch that names a key has all of its documents
    postings  (doc, scope, term, tf, len, block, sign), by term: 1 where a document comes to hold a term, -1 where it
              ceases to
    terms     (scope, term, df, total), by term: changes of document frequency and number of occurrences
    grams     (gram, term, df), by gram: the same under every piece of one to three characters of the term
    bounds    (scope, term, block, tf, len), by term: largest tf and smallest len of a batch in a block of documents
    sizes     (scope, n, words): changes of the number of documents and their words

A batch reads the documents that it replaces, takes back their postings and adds those of the new ones.  Readers add the
signs up, so a batch costs what has changed, and a batch that comes twice changes nothing.  ``sizes`` is written last: a
batch without it does not count.  Batches must come one after the other, as those of a stream do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.operators.search import postings

BUCKETS = 64
BLOCKS = 256  # blocks of documents that score bounds are kept for


@dataclass(frozen=True)
class Shape:
    """What is indexed: the columns that name a document, the scope it is searched in, its text; ``key`` names what is
    replaced as a whole, and the documents of a key are one group of hits.  Without a text there are documents only."""

    key: str = "conv_id"
    doc: tuple[str, ...] = ("conv_id", "idx")
    scope: tuple[str, ...] = ("owner",)
    text: str | None = "content"
    buckets: int = BUCKETS
    blocks: int = BLOCKS


def read_if_there(spark: SparkSession, path: str, merge: bool = False) -> DataFrame | None:
    """A Parquet table, None before its first write."""
    try:
        return spark.read.option("mergeSchema", merge).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def grams(term: Column, size: int) -> Column:
    positions = F.when(F.length(term) >= size, F.sequence(F.lit(1), F.length(term) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(positions, lambda i: F.substr(term, i, F.lit(size))))


def _key_text(key: str) -> Column:
    """The key as text that also stands for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


class Index:
    """The batches of an index that were whole when it was opened; None of them before the first write."""

    def __init__(self, spark: SparkSession, path: str, shape: Shape = Shape()):
        self.spark, self.path, self.shape = spark, path, shape
        done = read_if_there(spark, f"{path}/sizes")
        names = done.inputFiles() if done is not None else []
        self.batches = sorted({int(found[1]) for found in (re.search(r"/batch=(\d+)/", n) for n in names) if found})
        self._tables: dict[str, DataFrame] = {}

    def rows(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the whole batches, of some buckets or all.  A table's files are listed once."""
        if table not in self._tables:
            self._tables[table] = self.spark.read.option("mergeSchema", table == "docs").parquet(
                f"{self.path}/{table}").filter(F.col("batch").isin(self.batches))
        out = self._tables[table]
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))

    def buckets_of(self, values: DataFrame) -> list[int]:
        """Buckets that the values of the only column fall in; there are no more than buckets."""
        column = values.columns[0]
        return [r[0] for r in values.select(bucket(column, self.shape.buckets)).distinct().collect()]

    def changes(self, keys: DataFrame | None = None) -> DataFrame:
        """Newest rows of every key, marks of removal included; ``keys`` (one column) picks keys and their buckets."""
        rows = self.rows("docs")
        if keys is not None:
            wanted = keys.select(_key_text(keys.columns[0]).alias("_key")).distinct()
            rows = self.rows("docs", self.buckets_of(wanted)).join(wanted, "_key", "left_semi")
        if len(self.batches) < 2:
            return rows
        newest = rows.groupBy("_key").agg(F.max("batch").alias("_newest"))
        return rows.join(newest, "_key").filter(F.col("batch") == F.col("_newest")).drop("_newest")

    def docs(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The documents that are there now."""
        if not self.batches:
            return None
        return self.changes(keys).filter(~F.col("_gone")).drop("_key", "_gone", "batch", "bucket")

    def postings(self) -> DataFrame:
        """(doc, scope, term, tf, len) of the documents that are there now."""
        columns = [*self.shape.doc, *self.shape.scope, "term", "tf", "len"]
        rows = self.rows("postings")
        if len(self.batches) < 2:
            return rows.select(*columns)
        return rows.groupBy(*columns).agg(F.sum("sign").alias("_n")).filter("_n > 0").select(*columns)

    def frequencies(self, buckets: list[int] | None = None) -> DataFrame:
        """(scope, term, df, total) of the terms that are there now."""
        rows = self.rows("terms", buckets)
        columns = [*self.shape.scope, "term"]
        if len(self.batches) < 2:
            return rows.select(*columns, "df", "total")
        return rows.groupBy(*columns).agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter("df > 0")

    def gram_terms(self, wanted: DataFrame) -> DataFrame:
        """(gram, term) of the terms that hold a wanted gram; only the buckets of the grams asked for are read."""
        rows = self.rows("grams", self.buckets_of(wanted.select("gram"))).join(wanted.select("gram").distinct(), "gram")
        if len(self.batches) < 2:
            return rows.select("gram", "term")
        return rows.groupBy("gram", "term").agg(F.sum("df").alias("df")).filter("df > 0").drop("df")

    def bounds(self, buckets: list[int]) -> DataFrame:
        """(scope, term, block, tf, len): no document of the block beats these."""
        return self.rows("bounds", buckets).groupBy(*self.shape.scope, "term", "block").agg(
            F.max("tf").alias("tf"), F.min("len").alias("len"))

    def sizes(self) -> DataFrame:
        """(scope, n, words): number of documents, and of their words."""
        return self.rows("sizes").filter(F.col("n").isNotNull()).groupBy(*self.shape.scope).agg(
            F.sum("n").alias("n"), F.sum("words").alias("words")).filter("n > 0")


def _put(rows: DataFrame, path: str, number: int, sort: str | None, mode: str) -> None:
    """One batch of a table.  Rebalancing keeps files of one size: a hot bucket is split, small ones share a task."""
    rows = rows.withColumn("batch", F.lit(number))
    if sort is None:
        rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("batch").parquet(path)
        return
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", sort).write.mode(mode).option(
        "partitionOverwriteMode", "static").partitionBy("batch", "bucket").parquet(path)


def write_batch(docs: DataFrame | None, path: str, shape: Shape = Shape(), removed: DataFrame | None = None,
                spark: SparkSession | None = None, whole: bool = False) -> int:
    """Replace all documents of the keys in ``docs`` and drop those of ``removed``; returns the number of the batch.

    ``whole`` puts ``docs`` in the place of the whole index.  An interrupted batch does not count and may be repeated.
    """
    spark = spark or docs.sparkSession
    index, mode = Index(spark, path, shape), "overwrite" if whole else "append"
    taken = read_if_there(spark, f"{path}/docs")
    number = 1 + ((taken.agg(F.max("batch")).first()[0] or 0) if taken is not None else 0)
    if docs is not None:
        rows = docs.drop("batch", "bucket", "_key", "_gone").withColumn("_gone", F.lit(False))
        if removed is not None:
            marks = removed.select(shape.key).distinct().join(docs.select(shape.key).distinct(), shape.key, "left_anti")
            rows = rows.unionByName(marks.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    else:
        rows = removed.select(shape.key).distinct().withColumn("_gone", F.lit(True))
    named = rows.withColumn("_key", _key_text(shape.key)).withColumn("bucket", bucket("_key", shape.buckets))
    _put(named, f"{path}/docs", number, "_key", mode)
    if shape.text is None:
        _put(spark.range(1).select(F.lit(None).cast("long").alias("n")), f"{path}/sizes", number, None, mode)
        return number
    mine = spark.read.schema(named.withColumn("batch", F.lit(number)).schema).parquet(f"{path}/docs").filter(
        F.col("batch") == number)
    columns = [*dict.fromkeys([*shape.doc, *shape.scope])]
    signed = _signed(mine.filter(~F.col("_gone")), columns, shape, 1) if docs is not None else None
    first = whole or not index.batches
    if not first:
        old = index.changes(mine.select(shape.key)).filter(~F.col("_gone"))
        old = _signed(old, columns, shape, -1)
        signed = old if signed is None else signed.unionByName(old)
    if signed is None:  # nothing is there to be removed
        _put(spark.range(1).select(F.lit(None).cast("long").alias("n")), f"{path}/sizes", number, None, mode)
        return number
    found = postings(signed, [*columns, "sign"], "_text")
    if not first:  # what stays as it was need not be written
        every = [*columns, "term", "tf", "len"]
        found = found.groupBy(*every).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
    found = found.withColumn("block", bucket(shape.key, shape.blocks)).withColumn("bucket", bucket("term", shape.buckets))
    _put(found, f"{path}/postings", number, "term", mode)
    kept = spark.read.schema(found.withColumn("batch", F.lit(number)).schema).parquet(f"{path}/postings").filter(
        F.col("batch") == number)
    terms = kept.groupBy(*shape.scope, "term").agg(
        F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("total"))
    _put(terms.withColumn("bucket", bucket("term", shape.buckets)), f"{path}/terms", number, "term", mode)
    changed = kept.groupBy("term").agg(F.sum("sign").alias("df")).filter("df <> 0")
    pieces = F.concat(*[grams(F.col("term"), size) for size in (1, 2, 3)])
    _put(changed.select(F.explode(pieces).alias("gram"), "term", "df").withColumn("bucket", bucket("gram", shape.buckets)),
         f"{path}/grams", number, "gram", mode)
    bounds = kept.filter("sign > 0").groupBy(*shape.scope, "term", "block").agg(
        F.max("tf").alias("tf"), F.min("len").alias("len"))
    _put(bounds.withColumn("bucket", bucket("term", shape.buckets)), f"{path}/bounds", number, "term", mode)
    sizes = signed.groupBy(*shape.scope).agg(
        F.sum("sign").alias("n"), F.sum(F.col("sign") * word_count("_text")).alias("words"))
    mark = sizes.limit(0).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("n")), allowMissingColumns=True)
    _put(sizes.unionByName(mark).coalesce(1), f"{path}/sizes", number, None, mode)
    return number


def _signed(docs: DataFrame, columns: list[str], shape: Shape, sign: int) -> DataFrame:
    return docs.select(*columns, F.col(shape.text).alias("_text"), F.lit(sign).alias("sign"))


def copied(index: Index, path: str) -> None:
    """The documents that are there now as an index of one batch in another folder, to leave old batches behind."""
    write_batch(index.docs(), path, index.shape, whole=True)


# The document table by itself: an index without a text.


def write_search_docs(docs: DataFrame, path: str, removed: DataFrame | None = None, key: str = "conv_id",
                      buckets: int = BUCKETS, whole: bool = False) -> None:
    """Replace all documents of the keys in ``docs``, drop those of ``removed``; only the changes are written."""
    write_batch(docs, path, Shape(key, text=None, buckets=buckets), removed, whole=whole)


def delete_search_docs(spark: SparkSession, path: str, removed: DataFrame, key: str = "conv_id",
                       buckets: int = BUCKETS) -> None:
    """Drop all documents of the given keys."""
    if Index(spark, path).batches:
        write_batch(None, path, Shape(key, text=None, buckets=buckets), removed, spark)


def read_search_docs(spark: SparkSession, path: str, keys: DataFrame | None = None, buckets: int = BUCKETS
                     ) -> DataFrame | None:
    """The stored documents (of ``keys``: their buckets only are read), None before the first write."""
    return Index(spark, path, Shape(text=None, buckets=buckets)).docs(keys)
