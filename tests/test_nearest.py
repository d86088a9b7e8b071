"""The block search: no pair of points becomes a row, and its answers are exact."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import knn, nearest

from test_knn_compset import _as_dict, _brute_force, _large_groups, _numpy_knn, _points


def test_nearest_at_answers_each_row_within_its_reach(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MATRIX", 64)  # answers are put together from many small pieces
    points = [("a", f"n{i:02d}", float(i % 5), float("nan") if i == 7 else 0.0) for i in range(40)] + [("b", "far", 9.0, 0.0)]
    asking = [("a", f"t{i}", float(i), 0.0, kth) for i, kth in enumerate([float("inf"), 0.0, 1.0])] + [("c", "none", 0.0, 0.0, 1.0)]
    got = nearest.nearest_at(
        spark.createDataFrame(points, "place string, _nid string, _n0 double, _n1 double").repartition(3),
        spark.createDataFrame(asking, "place string, _tid string, _t0 double, _t1 double, _kth double"),
        ["place"], 2, 10,
    )
    got = {r["_tid"]: [(n["_nid"], n["_d2"]) for n in r["_near"]] for r in got.collect()}
    want = {}
    for place, tid, x, y, kth in asking:
        d = sorted(((x - a) ** 2 + (y - b) ** 2, nid) for p, nid, a, b in points if p == place and b == b)
        if d:
            want[tid] = [(nid, d2) for d2, nid in d if d2 <= kth][:10]
    assert got == want


@pytest.mark.parametrize("leaf_size", [20, 96])
def test_search_writes_targets_not_pairs(spark, leaf_size):
    """One row per target from its own block; of a leaf looked into only what is within reach."""
    df, rows = _large_groups(spark)
    feats = ["f0", "f1", "f2", "f3"]
    pool = knn.neighbour_pool(df, "city_code", "harp_property_id_no", feats, 10)
    layout = knn.leaf_layout(pool, "city_code", 4, leaf_size)
    search = knn.block_search(layout, layout.filter("_place = 1"), "city_code", 4, 10)
    assert search.own.count() == layout.filter("_place = 1").count()
    assert search.own.agg(F.max(F.size("_near"))).first()[0] == 10
    blocks = layout.groupBy("city_code", "_block").count().agg(F.max("count")).first()[0]
    assert leaf_size < blocks <= knn.BLOCK_SIZE


def test_leaves_asked_by_many_are_dealt_to_several_desks(spark, monkeypatch):
    monkeypatch.setattr(knn, "ASKING_LEAVES", 2)
    df, rows = _large_groups(spark)
    got = knn.knn_exact(df, ["f0", "f1", "f2", "f3"], k=10, leaf_size=20)
    assert _as_dict(got) == _numpy_knn(rows, 10)
    few, rows = _points(spark)
    assert _as_dict(knn.knn_exact(few, ["f0", "f1", "f2"], k=10)) == _brute_force(rows, 10)


def test_lsh_candidates_are_not_rows(spark, monkeypatch):
    """What buckets give is at most k per target and bucket; no window sorts candidate pairs."""
    df, rows = _large_groups(spark)
    big = df.filter("city_code = 'big'")
    limited, looks = [], []
    top_k, at = knn.top_k, knn.nearest_at
    monkeypatch.setattr(knn, "top_k", lambda *a: limited.append(a) or top_k(*a))
    monkeypatch.setattr(knn, "nearest_at", lambda *a, **o: looks.append(at(*a, **o)) or looks[-1])
    nothing = "city_code string, target_property_harp_ID string, harp_property_id_no string, knn_distance_metric double, neighbour_rank int"
    monkeypatch.setattr(knn, "knn_exact", lambda *a, **o: spark.createDataFrame([], nothing))
    approx = _as_dict(knn.knn_lsh(big, ["f0", "f1", "f2", "f3"], k=10))
    assert not limited and len(looks) == 3  # own bucket, own buckets of the other tables, neighbouring buckets
    assert all(look.agg(F.max(F.size("_near"))).first()[0] <= 10 for look in looks)
    exact = _numpy_knn([r for r in rows if r[0] == "big"], 10)
    assert len(set(exact) & set(approx)) / len(exact) >= 0.9
