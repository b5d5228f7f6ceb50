"""Joins of a large table with a table that may or may not be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_ROWS = 100_000
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``rows`` + 1 rows to decide whether a broadcast is safe."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
                rows: int = BROADCAST_ROWS, salt_by: Sequence[Column] | None = None,
                salts: int = SALTS) -> DataFrame:
    """Join ``fact``, whose key values may be hot, with the lookup table ``dim``.

    Up to ``rows`` rows ``dim`` is broadcast.  Beyond that every dim row is repeated once per salt and fact rows are
    spread over the salts, so that the rows of a hot key are shared by ``salts`` tasks.  Spark is told to merge there: it
    takes the repeated table to be no larger than the table itself, and would broadcast it.
    """
    on = list(on)
    if is_small(dim, rows):
        return fact.join(F.broadcast(dim), on, how)
    plain = [f.name for f in fact.schema.fields if f.name not in on and isinstance(f.dataType, T.AtomicType)]
    spread = salt_by or [F.col(c) for c in plain]
    if not spread:
        return fact.join(dim.hint("merge"), on, how)
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(salted_dim.hint("merge"), [*on, "_salt"], how).drop("_salt")


def frequency_join(fact: DataFrame, stats: DataFrame, on: Sequence[str], weight: str, how: str = "inner",
                   hot_share: int = 10_000, salts: int = SALTS) -> DataFrame:
    """Join ``fact`` with per-key statistics that tell how often a key occurs.

    Keys that make up at least 1/``hot_share`` of the total weight are hot; there can be no more than ``hot_share`` of
    them, so their list is safe to broadcast.  Rows of hot keys are spread over ``salts`` tasks, all other rows are
    joined as they are.
    """
    on = list(on)
    total = stats.agg(F.sum(weight).alias("total")).scalar()
    is_hot = F.col(weight) * hot_share >= total
    hot = stats.filter(is_hot).select(*on, F.lit(True).alias("_hot"))
    spread = [f.name for f in fact.schema.fields if f.name not in on and isinstance(f.dataType, T.AtomicType)]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    flagged = fact.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    repeated = stats.withColumn("_salt", F.explode(
        F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    # the statistics are far fewer rows than the facts, which then need no sort
    return flagged.join(repeated.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")
