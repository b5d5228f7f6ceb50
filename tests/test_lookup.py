"""Joins with a lookup table beyond the size that is broadcast."""

import pytest
from pyspark.sql import functions as F

from parley.lookup import lookup_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("plain", [True, False])
def test_large_lookup_table_is_not_broadcast(spark, how, plain):
    """Spark takes the repeated table for as small as the table, and would broadcast it."""
    fact = spark.range(500).select((F.col("id") % 7).alias("k"), *([F.col("id").alias("v")] if plain else []))
    dim = spark.range(1, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = lookup_join(fact, dim, ["k"], how, rows=10)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = [(i % 7, 2 * (i % 7) or None) for i in range(500) if how == "left" or i % 7]
    assert sorted(((r.k, r.twice) for r in joined.collect()), key=str) == sorted(want, key=str)
