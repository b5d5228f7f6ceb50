"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are dealt to the lists of their nearest centroid and rotated at random, so that the first dimensions tell about
the whole distance.  A probed list is scanned in column blocks: after each block a hypothesis test on the partial
distance abandons the candidates that can hardly come under the query's threshold, and the others go on.  What
survives all dimensions is measured exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.common import small_batches, stored

COLUMNS = 16  # dimensions of a column block
MAX_LISTS = 4096


@dataclass
class Index:
    """What every task needs; its size depends on the lists (at most MAX_LISTS) and the dimension alone."""

    dimension: int
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample: np.ndarray


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components and with a component that is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids ** 2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[k:k + 4096] @ centroids.T, 1) for k in range(0, len(x), 4096)]
                          or [np.zeros(0, np.int64)])


def fit(vectors: DataFrame, rows: int, dimension: int, sample_rows: int = 16_384, k: int = 10, target: float = 0.99,
        seed: int = 7) -> Index:
    """Centroids by k-means, and the number of probes, from at most ``sample_rows`` rows (the bound of the sample).

    The sample is taken by a hash of the row, so that it is the same in every run.  There are about sqrt(rows) lists.
    Probes are as many as find ``target`` of the nearest sample rows of 256 sample rows; neighbours in the whole table
    are nearer still and need fewer.
    """
    order = F.xxhash64("vec_id", "vector")
    share = F.lit(1.5 * sample_rows / max(1, rows))
    drawn = (vectors.filter(F.pmod(order, F.lit(1 << 40)) <= share * (1 << 40)).orderBy(order).limit(sample_rows)
             .select("vector").toArrow().column(0))
    sample = _matrix(drawn)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
    lists = int(min(MAX_LISTS, max(1, round(rows ** 0.5)), max(1, len(np.unique(sample, axis=0)))))
    centroids = np.unique(sample, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:lists]]
    for _ in range(10):
        own = _nearest(sample, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    asked = sample[rng.permutation(len(sample))[:256]]
    own = _nearest(sample, centroids)
    far = (asked ** 2).sum(1)[:, None] + (sample ** 2).sum(1) - 2 * asked @ sample.T
    near = np.argsort(far, 1, kind="stable")[:, 1:k + 1]
    rank = np.argsort(np.argsort((centroids ** 2).sum(1) - 2 * asked @ centroids.T, 1), 1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else len(centroids)
    return Index(dimension, rotation, centroids, min(probes, len(centroids)), sample[:4096])


def scan(query: np.ndarray, turned: np.ndarray, rows: np.ndarray, blocks: list[np.ndarray], bound: float, k: int,
         candidates: np.ndarray, significance: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``candidates`` (row numbers) those that may be among the k nearest, and their exact distances.

    ``blocks`` are the rotated rows in column blocks.  A candidate goes on if its partial distance, scaled to all
    dimensions, is within ``bound`` by a test of the given significance.
    """
    dimension = rows.shape[1]
    slack = 1e-9 * (1 + float(query @ query))
    alive = candidates
    partial = np.zeros(len(alive))
    done = 0
    for block in blocks:
        width = block.shape[1]
        own = block if len(alive) == len(block) else block[alive]
        partial += ((own - turned[done:done + width]) ** 2).sum(1)
        done += width
        factor = 1.0 if done == dimension else (1 + significance / done ** 0.5) ** 2 * done / dimension
        stay = partial <= bound * bound * factor + slack
        if not stay.all():
            alive, partial = alive[stay], partial[stay]
        if not len(alive):
            break
    exact = np.sqrt(((rows[alive] - query) ** 2).sum(1))
    if len(alive) > k:
        bar = np.partition(exact, k - 1)[k - 1]
        near = exact <= bar
        alive, exact = alive[near], exact[near]
    return alive, exact


def _scan_group(index: Index, k: int):
    """Of one block of a list and one block of its queries: the k nearest of the block for each query."""
    def apply(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, near, where = [], [], []
        if rows.num_rows and queries.num_rows:
            x, of = _matrix(rows.column("vector")), rows.column("vec_id").to_numpy()
            q, who = _matrix(queries.column("vector")), queries.column("query_id").to_numpy()
            bound = queries.column("bound").to_numpy().copy()
            spun = x @ index.rotation
            blocks = [np.ascontiguousarray(spun[:, c:c + COLUMNS]) for c in range(0, index.dimension, COLUMNS)]
            turned = q @ index.rotation
            for i in range(len(q)):
                at, exact = scan(q[i], turned[i], x, blocks, bound[i], k, np.flatnonzero(of != who[i]))
                best = np.lexsort((of[at], exact))[:k]
                ids.append(of[at[best]])
                near.append(exact[best])
                where.append(np.full(len(best), who[i]))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(where, np.int64), "vec_id": join(ids, np.int64),
                         "score": join(near, np.float64)})

    return apply


def nearest(table: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            sample_rows: int = 16_384, block_rows: int = 8192, block_queries: int = 2048,
            target: float = 0.99) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance of every row that ``queries`` selects.

    Ties go to the smaller id; rows with the query's own id are no candidates; of query rows with equal ids the least
    vector is asked.  Rows without an id, and vectors that are null, zero, hold null or non-finite components or have
    another dimension than most, take no part.  Repeated candidate rows count as often as they come.  Empty tables
    give no rows.  Lists are cut into blocks of about ``block_rows`` rows and their queries into blocks too, so that
    a list of very many equal vectors is many tasks.  Columns besides key and vector are not read, but ``queries``
    may use them.
    """
    spark = table.sparkSession
    small_batches(spark, 4096)
    rows = table.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asked"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == sizes.n)
    index = fit(rows.select("vec_id", "vector"), sizes["count"], sizes.n, sample_rows, k, target)

    def assign(batches):
        for batch in batches:
            own = _nearest(_matrix(batch.column(1)), index.centroids) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))],
                                             ["vec_id", "vector", "asked", "list"])

    dealt = stored(rows.mapInArrow(assign, "vec_id long, vector array<double>, asked boolean, list int"), "lists")
    asked = dealt.filter("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, who = _matrix(batch.column(1)), batch.column(0).to_numpy()
            far = (index.centroids ** 2).sum(1) - 2 * q @ index.centroids.T
            lists = np.argsort(far, 1, kind="stable")[:, :index.probes]
            direct = (q ** 2).sum(1)[:, None] + (index.sample ** 2).sum(1) - 2 * q @ index.sample.T
            if len(index.sample) > k + 1:  # the sample is part of the table: no k-th neighbour is farther than its own
                bound = np.sqrt(np.maximum(np.partition(direct, k + 1, 1)[:, k + 1], 0)) * (1 + 1e-9) + 1e-6
            else:
                bound = np.full(len(q), 1e300)
            bound = np.minimum(bound, 1e150)
            times = lists.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(who, times)), batch.column(1).take(pa.array(np.repeat(np.arange(len(q)), times))),
                pa.array(np.repeat(bound, times)), pa.array(lists.ravel().astype(np.int32))],
                ["query_id", "vector", "bound", "list"])

    probes = asked.mapInArrow(probe, "query_id long, vector array<double>, bound double, list int")
    count = dealt.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))

    def scanned(probes: DataFrame, per_list: float) -> DataFrame:
        # Queries of a list are at most all queries; every list has as many query blocks as the largest could need.
        q_blocks = max(1, int(np.ceil(per_list / block_queries)))
        left = (dealt.join(F.broadcast(count), "list")
                .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
                .select("list", "block", "part", "vec_id", "vector"))
        right = (probes.join(F.broadcast(count), "list").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
                 .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
                 .select("list", "block", "part", "query_id", "vector", "bound"))
        found = left.groupBy("list", "block", "part").cogroup(right.groupBy("list", "block", "part")).applyInArrow(
            _scan_group(index, k), "query_id long, vec_id long, score double")
        by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    asked_rows = asked.count()
    found = stored(scanned(probes, asked_rows * index.probes / max(1, len(index.centroids))), "found")
    # a query whose lists hold fewer than k candidates within its bound is asked again, of all lists and without a bound
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(full, "vec_id", "left_anti"), "short")
    again = short.count()
    if not again or sizes["count"] <= 1:
        return found
    lists = F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list")
    whole = short.select(F.col("vec_id").alias("query_id"), "vector", F.lit(1e150).alias("bound"), lists)
    return found.join(short, found["query_id"] == short["vec_id"], "left_anti").unionByName(scanned(whole, again))
