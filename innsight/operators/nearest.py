"""The nearest points of each row that asks at a place, place by place in Arrow batches.

Spark brings points and asking rows of one place together and sorts them, points
first; a task holds the points of one place and answers the asking rows as they
come, a few thousand distances at a time. A pair of points is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX = 1 << 15  # distances held at once, so that they stay near the processor


def deal(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows into as many tasks as the session shuffles to.

    Points are few bytes, by which Spark would merge them into a few tasks, but
    each is sorted many times or becomes ``leaf_size`` distances.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _closest(targets: np.ndarray, points: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, point, squared distance) of each target's ``k`` closest points within ``kth``, by target and distance.

    Of equal distances the earlier point is the closer one. A distance that is no
    number counts as the farthest.
    """
    d2 = np.subtract.outer(targets[:, 0], points[:, 0])
    d2 *= d2
    for i in range(1, points.shape[1]):
        gap = np.subtract.outer(targets[:, i], points[:, i])
        gap *= gap
        d2 += gap
    far, reach = d2, kth
    if np.isnan(d2.sum()) or np.isnan(kth).any():
        far, reach = np.where(np.isnan(d2), np.inf, d2), np.where(np.isnan(kth), np.inf, kth)
    if len(points) > k:
        reach = np.minimum(reach, np.partition(far, k - 1, axis=1)[:, k - 1])
    t, p = np.nonzero(far <= reach[:, None])
    order = np.lexsort((far[t, p], t))  # stable, so equal distances stay in the points' order
    t, p = t[order], p[order]
    counts = np.bincount(t, minlength=len(targets))
    kept = np.arange(len(t)) - np.repeat(np.cumsum(counts) - counts, counts) < k
    t, p = t[kept], p[kept]
    return t, p, d2[t, p]


def nearest_at(
    points: DataFrame, asking: DataFrame, place: Sequence[str], n_features: int, k: int, keep: Sequence[str] = (),
    vectors: bool = False,
) -> DataFrame:
    """(*place, *keep, _tid, _t<i>, _near) for each row of ``asking`` that finds something at its place.

    ``points``: ``place``, ``_nid``, ``_n<i>``; ``asking``: ``place``, ``keep``,
    ``_tid``, ``_t<i>`` and ``_kth``, the squared distance up to which it looks.
    ``_near`` is an array of (_d2, _nid), the ``k`` nearest by distance, then id;
    with ``vectors`` of (_d2, _nid, _n<i>).
    """
    place, keep = list(place), list(keep)
    x, t, n = ([f"_{s}{i}" for i in range(n_features)] for s in ("x", "t", "n"))
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    rows = points.select(
        *place, F.lit(0).alias("_kind"), "_nid", none(asking, "_tid"), *[F.col(a).alias(b) for a, b in zip(n, x)],
        F.lit(None).cast("double").alias("_kth"), *[none(asking, c) for c in keep],
    ).unionByName(
        asking.select(
            *place, F.lit(1).alias("_kind"), none(points, "_nid"), "_tid", *[F.col(a).alias(b) for a, b in zip(t, x)],
            "_kth", *keep,
        )
    )
    given_back = n if vectors else []
    near = T.ArrayType(
        T.StructType(
            [T.StructField("_d2", T.DoubleType()), T.StructField("_nid", points.schema["_nid"].dataType)]
            + [T.StructField(c, T.DoubleType()) for c in given_back]
        )
    )
    fields = [asking.schema[c] for c in [*place, *keep, "_tid"]] + [T.StructField(c, T.DoubleType()) for c in t]
    given = [*place, *keep, "_tid", *x]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, own = None, [], None, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = np.zeros(size - 1, dtype=bool)
            for c in [*place, "_kind"]:
                values = batch.column(c)
                new |= pc.not_equal(values.slice(1), values.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), size]
            kinds = batch.column("_kind").to_numpy()
            kth = batch.column("_kth").to_numpy(zero_copy_only=False)
            coordinates = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in x])
            found: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
            for low, high in zip(bounds[:-1], bounds[1:]):
                here = tuple(batch.column(c)[low].as_py() for c in place)
                if kinds[low] == 0:
                    if here != at:
                        at, held = here, []
                    held.append((batch.column("_nid").slice(low, high - low), coordinates[low:high]))
                    ids = None
                    continue
                if here != at:
                    continue
                if ids is None:
                    ids, own = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                step = max(1, MATRIX // len(own))
                for start in range(low, high, step):
                    end = min(high, start + step)
                    a, p, d2 = _closest(coordinates[start:end], own, kth[start:end], k)
                    found.append((a + start, ids.take(pa.array(p)), d2, own[p] if vectors else d2))
            if not found:
                continue
            counts = np.bincount(np.concatenate([f[0] for f in found]), minlength=size)
            rows_found = np.flatnonzero(counts)
            pairs = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([f[2] for f in found])),
                    pa.concat_arrays([f[1] for f in found]),
                    *[pa.array(np.concatenate([f[3][:, i] for f in found])) for i in range(len(given_back))],
                ],
                names=["_d2", "_nid", *given_back],
            )
            offsets = np.concatenate([[0], np.cumsum(counts[rows_found])]).astype(np.int32)
            asked = batch.take(pa.array(rows_found))
            yield pa.RecordBatch.from_arrays(
                [*[asked.column(c) for c in given], pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                names=[*place, *keep, "_tid", *t, "_near"],
            )

    dealt = deal(rows, *place).sortWithinPartitions(*place, "_kind", "_nid")
    return dealt.mapInArrow(answer, T.StructType([*fields, T.StructField("_near", near)]))
