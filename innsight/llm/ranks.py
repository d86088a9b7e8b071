"""Running sums and ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_digits(rows: int) -> int:
    """Hex digits of a hash prefix that deals ``rows`` into about sqrt(rows) buckets."""
    digits = 0
    while 16 ** (2 * digits) < rows:
        digits += 1
    return digits


def running_sum(
    df: DataFrame, group: str, bucket: str, order: list[Column], value: str, before: str
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the group's earlier rows.

    ``group`` and ``bucket`` hold no nulls. ``bucket`` splits a group into consecutive ranges of ``order``, so a group
    with any share of the rows is summed bucket by bucket: one window inside the
    buckets, one over the buckets' sums. Both are short when there are about
    sqrt(rows) buckets.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    over_buckets = Window.partitionBy(group).orderBy(bucket)
    offsets = sums.select(
        group, bucket, (F.sum("_sum").over(over_buckets) - F.col("_sum")).alias("_offset")
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(before, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [group, bucket])
        .withColumn(before, F.col(before) + F.col("_offset"))
        .drop("_offset")
    )
