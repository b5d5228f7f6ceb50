"""Order-dependent computations that survive one very large group.

A plain ``Window.partitionBy(conv_id)`` puts a whole conversation into one task, and one conversation may hold a
third of all messages.  The helpers here work in two levels instead.  Rows are grouped by (key, bucket) where the
bucket is a range of list positions, so a task never sees more than one bucket of a group.  Each bucket is reduced to
one summary row; a window over those few rows gives every bucket what came before and after it, and the result is
joined back on (key, bucket), which is again never hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BUCKET_ROWS = 4096


def bucket_of(position: str, rows: int = BUCKET_ROWS) -> Column:
    """Bucket number of a list position."""
    return F.expr(f"cast(`{position}` as bigint) div {rows}")


def before(keys: Sequence[str], bucket: str) -> WindowSpec:
    """All summary rows of the group in earlier buckets."""
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def after(keys: Sequence[str], bucket: str) -> WindowSpec:
    """All summary rows of the group in later buckets, as a frame that only grows: one that ends at the last row is added
    up anew for each row.  The latest comes first."""
    return Window.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)


def whole(keys: Sequence[str]) -> WindowSpec:
    """All summary rows of the group."""
    return Window.partitionBy(*keys)


def carry(df: DataFrame, keys: Sequence[str], bucket: str, summary: Sequence[Column],
          derive: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """Join per-bucket values derived from the bucket summaries of the same group.

    ``summary`` are aggregates over one bucket, ``derive`` maps the summary table (keys, bucket, aggregates) to one
    with the carried columns, using the windows above.
    """
    totals = df.groupBy(*keys, bucket).agg(*summary)
    return df.join(derive(totals), [*keys, bucket], how)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: str, name: str,
            total: str | None = None) -> DataFrame:
    """1-based position within ``keys`` by ``order``; ``bucket`` must not decrease along that order.

    With ``total`` the size of the group is added too.
    """
    local = Window.partitionBy(*keys, bucket).orderBy(*order)

    def derive(totals: DataFrame) -> DataFrame:
        columns = [F.coalesce(F.sum("_rows").over(before(keys, bucket)), F.lit(0)).alias("_offset")]
        if total:
            columns.append(F.sum("_rows").over(whole(keys)).alias(total))
        return totals.select(*keys, bucket, *columns)

    numbered = carry(df, keys, bucket, [F.count(F.lit(1)).alias("_rows")], derive)
    return numbered.withColumn(name, F.col("_offset") + F.row_number().over(local)).drop("_offset")


def running_max_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: str, value: Column,
                       name: str) -> DataFrame:
    """Largest ``value`` among the rows before the current one, null for the first row."""
    local = (Window.partitionBy(*keys, bucket).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))

    def derive(totals: DataFrame) -> DataFrame:
        return totals.select(*keys, bucket, F.max("_top").over(before(keys, bucket)).alias("_carried"))

    carried = carry(df, keys, bucket, [F.max(value).alias("_top")], derive)
    return carried.withColumn(name, F.greatest(F.col("_carried"), F.max(value).over(local))).drop("_carried")


def spread_join(df: DataFrame, side: DataFrame, keys: Sequence[str], bucket: str, how: str = "inner") -> DataFrame:
    """Join ``side`` (one row per ``keys``) to rows of possibly very large groups.

    The side is first brought to the buckets that occur, so the join with the rows is on (keys, bucket).
    """
    buckets = df.select(*keys, bucket).distinct().join(side, list(keys), how)
    return df.join(buckets, [*keys, bucket], how)
