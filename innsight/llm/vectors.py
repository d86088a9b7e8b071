"""Integer vectors and blocks of rows, shared by the vector searches.

Vectors become whole numbers (``floor(scale * x)``), so that scores are exact.
A block is a bounded number of rows that lie next to each other in some order;
it travels as one row of packed arrays. A search pairs the blocks of its queries
with the blocks of all rows by equi-joins on block numbers.

Defined cases: a vector that is null or holds a null, NaN or infinite component
takes no part; components beyond +-2^25 after scaling count as +-2^25, so that
products of up to 8,191 components fit 64 bits; of two vectors of different
length the shorter one counts as filled up with zeros; an id that is no whole
number counts as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.tables import column, materialize

LARGEST = 1 << 25  # components are held within this


def usable_vector(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    limit = F.lit(float(LARGEST))
    return F.transform(
        vector,
        lambda x: F.floor(F.greatest(-limit, F.least(limit, F.lit(float(scale)) * x.cast("double")))).cast("int"),
    )


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, **extra: Column) -> DataFrame:
    """(tag, id, vec, *extra): the usable vectors, each row with a number of its own; written once."""
    vector = column(df, vector_col)
    return materialize(
        df.filter(usable_vector(vector)).select(
            F.monotonically_increasing_id().alias("tag"),
            column(df, id_col).try_cast("long").alias("id"),
            whole_numbers(vector, scale).alias("vec"),
            *[value.alias(name) for name, value in extra.items()],
        ),
        "vectors",
    )


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add ``place``: the row's number from 0 in ``order``, whose columns make rows distinct.

    A row's place is its place in a range partition plus the sizes of the
    partitions before it, so neither a task nor a window holds all rows.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33)
    # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(earlier), "_part")
        .withColumn("place", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before"))
        .drop("_at", "_part", "_before")
    )


def in_blocks(df: DataFrame, order: list[str], rows: int, label: str) -> DataFrame:
    """Add ``block`` and ``pos``: rows in ``order`` cut into blocks of ``rows``."""
    return numbered(df, order, label).select(
        "*", F.floor(F.col("place") / rows).cast("long").alias("block"), (F.col("place") % rows).cast("int").alias("pos")
    ).drop("place")


def packed_blocks(
    rows: DataFrame, fields: list[str], pack: Callable[[dict], dict], schema: str, label: str
) -> DataFrame:
    """One row per block: ``block`` and what ``pack`` makes of its rows' fields, in the order of ``pos``; written once.

    ``pack`` gets a dictionary from field to values and returns one from column to value.
    """
    gathered = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            for i in range(batch.num_rows):
                items = lists[i].values
                out = pack({f: items.field(f) for f in fields})
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([batch.column("block")[i].as_py()], pa.int64())}
                    | {k: pa.array([v]) for k, v in out.items()}
                )

    return materialize(gathered.mapInArrow(run, f"block long, {schema}"), label)


def vector_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from a list array; shorter ones are filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), dtype=np.int32)
    if len(lengths) and (lengths == width).all():
        out[:] = values.reshape(-1, width)
        return out
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def id_arrays(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the largest number for null, whether there is an id)."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64), there


def exact_matrix(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which their products are exact.

    Doubles (fast) as long as no sum of products can pass 2^53, else 64-bit integers.
    """
    most = 1
    for part in parts:
        most *= max(1, int(np.abs(part).max(initial=0)))
    kind = np.float64 if most * max(1, parts[0].shape[1]) < 1 << 53 else np.int64
    return [part.astype(kind) for part in parts]


def dimensions(vectors: DataFrame) -> int:
    """Length of the longest vector, 0 without vectors."""
    return vectors.agg(F.max(F.size("vec"))).first()[0] or 0
