"""Hard negatives (threshold algorithm) and exact top-k (pivot table) against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from innsight.llm import hard_negatives as hn
from innsight.llm import pivot_search as ps

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(vector) -> bool:
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def whole(vector, scale: int) -> list[int]:
    return [math.floor(scale * x) for x in vector]


def score(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))


def id_order(value) -> tuple:
    return (value is None, value or 0)


def brute_top_k(rows, k: int, step: int) -> list[tuple]:
    kept = [(i, r[0], whole(r[1], ps.SCALE)) for i, r in enumerate(rows) if usable(r[1])]
    out = []
    for i, query, vec in kept:
        if query is None or query % step:
            continue
        others = sorted(((-score(vec, v), id_order(x), x) for j, x, v in kept if j != i), key=lambda t: t[:2])
        out += [(query, n + 1, x, -s) for n, (s, _, x) in enumerate(others[:k])]
    return out


def brute_negatives(rows, step: int, positives: int, negatives: int) -> list[tuple]:
    kept = [(i, r[0], whole(r[1], hn.SCALE), r[2]) for i, r in enumerate(rows) if r[2] is not None and usable(r[1])]
    out = []
    for i, anchor, vec, label in kept:
        if anchor is None or anchor % step:
            continue
        scored = sorted(
            ((-score(vec, v), id_order(x), x, lab) for j, x, v, lab in kept if j != i), key=lambda t: t[:2]
        )
        for p, _, pid, _ in [t for t in scored if t[3] == label][:positives]:
            found = [t for t in scored if t[3] != label and 50 * -p <= 100 * -t[0] <= 95 * -p][:negatives]
            out += [(anchor, pid, n + 1, t[2], -p, -t[0]) for n, t in enumerate(found)]
    return out


def vectors(n: int, dims: int, labels: int, seed: int, hot: float = 0.3) -> list[tuple]:
    """Clustered rows; a share ``hot`` has label 0; some rows are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = 0 if rng.random() < hot else int(rng.integers(labels))
        vec = (centres[label] + rng.normal(size=dims)) / 4
        rows.append((i, [float(x) for x in vec], label))
    for i in range(0, n, 9):  # copies under other ids
        rows[-1 - i] = (rows[-1 - i][0], rows[i][1], rows[-1 - i][2])
    return rows


ODD = [
    (None, [0.5, 0.25, 0.1], 1),
    (40, None, 1),
    (60, [0.5, None, 0.1], 1),
    (80, [0.5, float("nan"), 0.1], 0),
    (100, [float("inf"), 0.0, 0.1], 0),
    (100, [0.2, 0.4, 0.1], 0),
    (100, [0.2, 0.4, 0.1], 0),
    (120, [0.2, 0.4], 0),  # shorter
    (140, [], 1),
    (160, [0.0, 0.0, 0.0], None),
    (7, [0.4, 0.4, 0.1], 1),
    (8, [0.1, 0.3, -0.2], 1),
    (9, [-0.3, -0.3, 0.2], 0),
]


def top_k(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in ps.top_k_inner_product(df, **kwargs).select("query_id", "rank", "id", "score").collect()]


def negatives(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in hn.hard_negatives(df, **kwargs).collect()]


def same(got, wanted) -> None:
    by = lambda t: tuple(id_order(x) for x in t)
    assert sorted(got, key=by) == sorted(wanted, key=by)


@pytest.mark.parametrize("blocks", [(4096, 256), (50, 7)])
def test_top_k_equals_brute_force(spark, blocks):
    rows = vectors(400, 6, 4, seed=1)
    got = top_k(spark, rows, k=5, query_step=10, pivots=6, row_block=blocks[0], query_block=blocks[1])
    same(got, brute_top_k(rows, 5, 10))


def test_top_k_defined_cases(spark):
    same(top_k(spark, ODD, k=3), brute_top_k(ODD, 3, ps.QUERY_STEP))
    same(top_k(spark, ODD, k=30, row_block=2, query_block=1), brute_top_k(ODD, 30, ps.QUERY_STEP))


def test_top_k_without_rows_or_queries(spark):
    assert top_k(spark, []) == []
    assert top_k(spark, [(1, [1.0], 0), (None, [1.0], 0)]) == []
    assert top_k(spark, [(20, [1.0], 0)]) == []


def test_top_k_of_equal_vectors_goes_by_id(spark):
    rows = [(i, [0.5, 0.5], 0) for i in range(200)]
    got = top_k(spark, rows, k=4, query_step=50, row_block=16, query_block=2)
    same(got, brute_top_k(rows, 4, 50))


def test_top_k_ignores_other_columns(spark):
    rows = vectors(60, 4, 3, seed=2)
    df = spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], SCHEMA + ", tag string, Block int, rank int"
    )
    got = [tuple(r) for r in ps.top_k_inner_product(df, k=3).collect()]
    same(got, brute_top_k(rows, 3, ps.QUERY_STEP))


def test_bounds_save_scores():
    """Far rows of a block are not scored: rows behind the k-th score's bound are left out."""
    rng = np.random.default_rng(3)
    vecs = np.concatenate([rng.integers(0, 5, (500, 8)) + 90, rng.integers(0, 5, (500, 8)) - 90]).astype(np.int32)
    pivots = vecs[[0, 500]].astype(float)
    dist = np.stack([np.linalg.norm(vecs - p, axis=1) for p in pivots], axis=1)
    norms = (vecs.astype(float) ** 2).sum(axis=1)
    bound = (norms + norms[1] - (np.abs(dist - dist[1]).max(axis=1)) ** 2) / 2 + 1
    kth = np.sort(vecs.astype(int) @ vecs[1])[-20]
    assert (bound >= kth).sum() <= 500


@pytest.mark.parametrize("blocks", [(4096, 256), (40, 5)])
def test_negatives_equal_brute_force(spark, blocks):
    rows = vectors(400, 6, 4, seed=4)
    got = negatives(spark, rows, anchor_step=10, shard=blocks[0], anchor_block=blocks[1])
    same(got, brute_negatives(rows, 10, hn.POSITIVES, hn.NEGATIVES))


def test_negatives_defined_cases(spark):
    got = negatives(spark, ODD, anchor_step=20)
    same(got, brute_negatives(ODD, 20, hn.POSITIVES, hn.NEGATIVES))
    same(negatives(spark, ODD, anchor_step=1, shard=2, anchor_block=1), brute_negatives(ODD, 1, hn.POSITIVES, hn.NEGATIVES))


def test_negatives_without_rows_labels_or_anchors(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(50, [1.0], None)]) == []
    assert negatives(spark, [(51, [1.0], 1), (52, [1.0], 0)]) == []
    assert negatives(spark, [(50, [1.0], 1), (52, [1.0], 0)]) == []


def test_negatives_of_one_hot_label_and_equal_rows(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(150)] + [(200 + i, [0.4, 0.2 + i / 100], 2) for i in range(20)]
    got = negatives(spark, rows, anchor_step=25, shard=16, anchor_block=2)
    same(got, brute_negatives(rows, 25, hn.POSITIVES, hn.NEGATIVES))


def test_threshold_stops_before_the_end():
    """Of rows with one leading component, the search reads a few places of the lists."""
    n = 4096
    vecs = np.stack([np.arange(n), np.zeros(n, dtype=int)], axis=1).astype(np.int32)
    lists = np.argsort(-vecs, axis=0, kind="stable").astype(np.int32)

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, key):
            out = np.asarray(super().__getitem__(key))
            if isinstance(key, np.ndarray):
                Counting.read += len(out)
            return out

    counted = vecs.view(Counting)
    rank = lambda rows, scores: np.lexsort((rows, -scores))
    [(rows, scores)] = hn.threshold_search(np.array([3, 0]), counted, lists, np.ones(n, bool), [(0, 10**9)], 5, rank)
    assert list(rows) == [4095, 4094, 4093, 4092, 4091] and scores[0] == 3 * 4095
    assert Counting.read <= 64
