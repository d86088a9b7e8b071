"""Writers for the two analyses' outputs.

* ``write_partitioned`` -- Parquet partitioned by some columns (the rate counts
  by ``year, month, day``; the comp sets by ``city_code``). The rows are first
  *rebalanced* on the partition columns (``REBALANCE`` hint): AQE then splits
  a partition holding a hot day or city into several tasks and merges tiny
  ones, so one hot key neither lands in a single writer task nor leaves
  thousands of small files.
* ``write_sorted_csv`` -- CSV files with headers whose names, in order, hold the
  rows in a given order: range-partitioned, each task sorts and writes its range.
* ``write_single_csv`` -- one CSV file with a header, rows in a given order, for
  results whose size is bounded (a daily summary). The upstream plan keeps all
  its parallelism; only the final exchange goes to one partition, which is then
  sorted and written (sorting *before* a single repartition would not keep the
  order).
* ``save_partitioned_table`` -- a managed catalog table, partitioned.

An overwrite goes through a staging folder (``sinks.publish``): a write that
fails leaves the old output in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from innsight.sinks.publish import replace_output


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str],
    mode: str = "overwrite",
    replace_partitions_only: bool = False,
) -> list[str] | None:
    """Write Parquet under ``col=value/`` directories.

    With ``mode="overwrite"`` the whole output is replaced (so partitions of an
    earlier run that are absent now disappear); ``replace_partitions_only``
    replaces only the partitions present in ``df``, for incremental daily runs,
    and returns their folders.
    """
    writer = df.hint("rebalance", *partition_cols).write.partitionBy(*partition_cols)
    if mode != "overwrite":
        writer.mode(mode).parquet(path)
        return None
    return replace_output(df.sparkSession, path, writer.parquet, len(partition_cols) if replace_partitions_only else None)


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    if mode == "overwrite":
        replace_output(df.sparkSession, path, lambda staging: df.write.csv(staging, header=True))
    else:
        df.write.mode(mode).csv(path, header=True)


def write_sorted_csv(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    drop: Sequence[str] = (),
    mode: str = "overwrite",
    files: int | None = None,
) -> None:
    """CSV files in the order of ``order_by``: no file's rows come after the next file's.

    ``files`` is the number of ranges; by default as many as shuffle partitions,
    which AQE merges where they are small.
    """
    kept = df.drop(*drop)
    ranged = kept.repartitionByRange(files, *order_by) if files else kept.repartitionByRange(*order_by)
    _write_csv(ranged.sortWithinPartitions(*order_by), path, mode)


def write_single_csv(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = (),
    drop: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """One CSV file with a header, for small results; array / vector columns must be dropped (``drop``)."""
    one = df.drop(*drop).repartition(1)
    if order_by:
        one = one.sortWithinPartitions(*order_by)
    _write_csv(one, path, mode)


def save_partitioned_table(
    df: DataFrame, table: str, partition_cols: Sequence[str], mode: str = "overwrite"
) -> None:
    """Managed Parquet table in the catalog, partitioned by ``partition_cols``."""
    df.hint("rebalance", *partition_cols).write.saveAsTable(
        table, format="parquet", mode=mode, partitionBy=list(partition_cols)
    )


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read back a partitioned output.

    Pass the written schema (``df.schema``) so partition columns keep their type:
    discovery alone turns directory values that all look numeric (``001``) into
    integers.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
