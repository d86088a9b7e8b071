"""Reading inputs, durable intermediate tables, and helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.plans.lineage import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; the path may belong to any store Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back.

    The stages after it restart from these files when an executor is lost. They
    go with the current job's cuts, or when the process ends.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    """The column called ``name``, whatever signs the name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, made on first use.

    Functions are pickled by value and unpickled anew for each task, so a module
    global would be rebuilt by every task. Workers are shared by all stages of an
    application; only the object asked for last is kept, so that the caches of
    earlier stages do not add up.
    """
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        release_memory()
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Give back to the system what this process has freed: Arrow's buffers and the heap.

    Workers live as long as their executor; else each would keep the most that
    any of its tasks has needed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving memory back at the end of each task."""

    def and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return and_release


def binary_values(column: pa.Array) -> list[bytes]:
    """The values of a binary or string array as bytes, null as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [v or b"" for v in column.to_pylist()]


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by ``keys`` into tables of whole groups.

    Each table holds one or more complete groups; only the last group of a batch
    is carried on, so memory is one batch plus the largest group.
    """
    carry: list[pa.RecordBatch] = []

    def last_start(batch: pa.RecordBatch) -> int:
        start = 0
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changed = np.flatnonzero(values[1:] != values[:-1])
            if len(changed):
                start = max(start, int(changed[-1]) + 1)
        return start

    def key_of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if carry and key_of(carry[-1], carry[-1].num_rows - 1) != key_of(batch, 0):
            yield pa.Table.from_batches(carry)
            carry = []
        cut = last_start(batch)
        if cut:
            yield pa.Table.from_batches([*carry, batch.slice(0, cut)])
            carry = []
        carry.append(batch.slice(cut))
    if carry:
        yield pa.Table.from_batches(carry)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start rows of the groups of a table sorted by ``keys``, and its length."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), n)
