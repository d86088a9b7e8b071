"""kNN (exact, LSH), property metrics and competitive-set invariants."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.operators import compset as cs
from innsight.operators import knn, properties
from innsight.plans.inspect import plan_text
from innsight.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def _points(spark, n_per_city=(1, 3, 25, 60), dims=3, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(n_per_city):
        pts = rng.integers(0, 4, size=(n, dims)).astype(float)  # coarse grid -> many exact ties
        for i, p in enumerate(pts):
            rows.append((f"c{c}", f"p{c}_{i:03d}", *map(float, p)))
    schema = "city_code string, harp_property_id_no string, " + ", ".join(f"f{i} double" for i in range(dims))
    return spark.createDataFrame(rows, schema), rows


def _brute_force(rows, k):
    out = {}
    by_city = {}
    for r in rows:
        by_city.setdefault(r[0], []).append(r)
    for city, rs in by_city.items():
        for t in rs:
            d = sorted((sum((a - b) ** 2 for a, b in zip(t[2:], n[2:])), n[1]) for n in rs)
            out.update({(city, t[1], nid): rank for rank, (_, nid) in enumerate(d[:k], start=1)})
    return out


def _as_dict(df):
    return {(r["city_code"], r[knn.TARGET_ID], r[knn.NEIGHBOUR_ID]): r[knn.RANK] for r in df.collect()}


@pytest.mark.parametrize("leaf_size", [knn.LEAF_SIZE, 10])
def test_knn_exact_equals_brute_force(spark, leaf_size):
    df, rows = _points(spark)
    got = knn.knn_exact(df, ["f0", "f1", "f2"], k=10, leaf_size=leaf_size)
    assert _as_dict(got) == _brute_force(rows, 10)


def test_knn_short_cities_and_self_first(spark):
    df, rows = _points(spark)
    got = knn.knn_exact(df, ["f0", "f1", "f2"], k=10).collect()
    per_target = {}
    for r in got:
        per_target.setdefault((r["city_code"], r[knn.TARGET_ID]), []).append(r)
    sizes = {c: sum(1 for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    for (city, _), rs in per_target.items():
        assert len(rs) == min(10, sizes[city])
        assert all(r[knn.NEIGHBOUR_ID].startswith(f"p{city[1:]}_") for r in rs)  # never crosses cities
        assert min(r[knn.DISTANCE] for r in rs) == 0.0


def test_knn_lsh_recall_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    dims = 8  # first components keep the test fast; recall is what is checked
    pts = emb.select(
        F.col("label").cast("string").alias("city_code"),
        F.col("vec_id").cast("string").alias("harp_property_id_no"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)],
    )
    feats = [f"f{i}" for i in range(dims)]
    exact = _as_dict(knn.knn_exact(pts, feats, k=10))
    approx = _as_dict(knn.knn_lsh(pts, feats, k=10, bucket_candidates=20, num_hash_tables=6))
    hit = len(set(exact) & set(approx)) / len(exact)
    assert hit >= 0.9
    assert len(approx) == len(exact)  # no target is short of neighbours


def _bookings(spark):
    d = dt.date
    rows = [
        # p1: renamed later; two bookings under an older chain are dropped by the 5-key join
        ("p1", "Old", "ChainA", "c1", 1.0, 1.0, d(2019, 1, 1), "3-STAR", 100.0, 200.0),
        ("p1", "New", "ChainA", "c1", 1.0, 1.0, d(2019, 6, 1), "4-STAR", 110.0, 210.0),
        ("p1", "Old", "ChainB", "c1", 1.0, 1.0, d(2018, 1, 1), "5-STAR", 999.0, 999.0),
        # p2: two names tie on the latest date -> two property rows
        ("p2", "X", "ChainA", "c1", 2.0, 2.0, d(2019, 5, 1), "2-STAR", 50.0, 60.0),
        ("p2", "Y", "ChainA", "c1", 2.0, 2.0, d(2019, 5, 1), "2-STAR", 70.0, 80.0),
        # p3: malformed / too short star ratings
        ("p3", "Z", "ChainC", "c2", 3.0, 3.0, d(2019, 5, 1), "x-STAR", 10.0, 20.0),
        ("p3", "Z", "ChainC", "c2", 3.0, 3.0, d(2019, 5, 2), "4", 10.0, 20.0),
        ("p3", "Z", "ChainC", "c2", 3.0, 3.0, d(2019, 5, 3), None, 10.0, 20.0),
        # p4: null chain never joins
        ("p4", "W", None, "c2", 4.0, 4.0, d(2019, 5, 1), "3-STAR", 10.0, 20.0),
    ]
    schema = (
        "harp_property_id_no string, hotel_name string, hotel_chain_name string, city_code string, "
        "x double, y double, created_date date, star_rating string, yield double, adr double"
    )
    return spark.createDataFrame(rows, schema)


def test_property_metrics_semantics(spark):
    got = {(r["harp_property_id_no"], r["hotel_name"]): r for r in properties.property_metrics(_bookings(spark)).collect()}
    assert set(got) == {("p1", "New"), ("p2", "X"), ("p2", "Y"), ("p3", "Z")}
    p1 = got[("p1", "New")]
    assert (p1["num_bookings"], p1["star_rating"], p1["star_rating_number"]) == (2, "4-STAR", 4)
    assert p1["avg_yield"] == pytest.approx(105.0) and p1["avg_adr"] == pytest.approx(205.0)
    assert got[("p2", "X")]["num_bookings"] == 2 and got[("p2", "Y")]["avg_yield"] == pytest.approx(60.0)
    p3 = got[("p3", "Z")]
    assert p3["num_bookings"] == 1 and p3["star_rating_number"] is None  # 'x' is not a digit


def test_property_metrics_equal_a_plain_fold(spark):
    """Against the definition, row by row on the driver."""
    bookings = _bookings(spark).collect()
    latest, dates = {}, {}
    for b in bookings:
        name = (b["harp_property_id_no"], b["hotel_name"], b["hotel_chain_name"], b["city_code"], b["x"], b["y"])
        dates[name] = max(dates.get(name, b["created_date"]), b["created_date"])
        latest[name[0]] = max(latest.get(name[0], b["created_date"]), b["created_date"])
    want = {}
    for name, date in dates.items():
        if date == latest[name[0]] and None not in name:
            own = [
                b for b in bookings
                if (b["harp_property_id_no"], b["hotel_chain_name"], b["city_code"], b["x"], b["y"]) == (name[0], *name[2:])
                and b["star_rating"] and len(b["star_rating"]) > 1
            ]
            if own:
                want[name] = (len(own), max(b["star_rating"] for b in own), sum(b["yield"] for b in own) / len(own))
    got = {tuple(r[c] for c in properties.NAME_KEYS): (r["num_bookings"], r["star_rating"], r["avg_yield"])
           for r in properties.property_metrics(_bookings(spark)).collect()}
    assert got == want


def test_property_metrics_have_no_window_on_the_property(spark):
    plan = plan_text(properties.property_metrics(fx.fixture_bookings(spark, SF_SMALL)), "simple")
    assert "Window" not in plan and "FileScan parquet" in plan


def test_two_locations_are_cleaned_before_one_row_is_picked(spark):
    """A hotel whose better-booked location is invalid stays with its valid one."""
    rows = [(f"p{i}", "N", "C", "c", float(i), float(i), 1, "3-STAR", 3, 10.0, 100.0 + i) for i in range(1, 40)]
    rows += [("two", "N", "C", "c", 999.0, 20.0, 50, "4-STAR", 4, 10.0, 90.0), ("two", "N", "C", "c", 20.0, 20.0, 2, "4-STAR", 4, 10.0, 90.0)]
    props = spark.createDataFrame(
        rows, "harp_property_id_no string, hotel_name string, hotel_chain_name string, city_code string, x double, y double, "
        "num_bookings long, star_rating string, star_rating_number int, avg_yield double, avg_adr double"
    )
    points = {r["harp_property_id_no"]: r for r in cs.prepare_points(props).collect()}
    assert points["two"]["x"] == 20.0 and points["two"]["num_bookings"] == 2
    # the deviations are those of all clean rows
    clean = cs.geo_clean(props)
    sd = clean.agg(F.stddev_samp("avg_adr")).first()[0]
    assert points["two"]["scaled_avg_adr"] == pytest.approx(90.0 / sd)


def test_comp_set_invariants(spark):
    points = cs.prepare_points(properties.property_metrics(fx.fixture_bookings(spark, SF_SMALL)))
    m = cs.comp_set_metrics(cs.comp_set(points, k=10)).cache()
    sets = m.groupBy("city_code", knn.TARGET_ID).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("compset_share_of_bookings").alias("share"),
        F.min("compset_yield_performance_rank").alias("r1"),
        F.min("compset_share_of_bookings_rank").alias("r2"),
        F.sum(F.when(F.col(knn.NEIGHBOUR_ID) == F.col(knn.TARGET_ID), 1).otherwise(0)).alias("self"),
    )
    sizes = points.groupBy("city_code").agg(F.count(F.lit(1)).alias("size"))
    rows = sets.join(sizes, "city_code").collect()
    assert rows
    for r in rows:
        assert r["n"] == min(10, r["size"])
        assert r["share"] == pytest.approx(1.0)
        assert r["r1"] == 1 and r["r2"] == 1
        assert r["self"] == 1
    m.unpersist()


def test_null_and_zero_yield_ratios(spark):
    base = ("A", 0.0, 0.0, 5, "3-STAR", 3)
    rows = [
        ("c", "t", "T", *base, 5.0, 100.0, 0.0, 0.0, 0.0, 0.0),
        ("c", "n", "N", *base, 10.0, 100.0, 0.0, 0.0, 0.0, 0.0),
        ("c", "u", "U", *base, None, 100.0, 0.0, 0.0, 0.0, 0.0),
        ("d", "z", "Z", *base, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0),
    ]
    schema = (
        "city_code string, harp_property_id_no string, hotel_name string, hotel_chain_name string, x double, "
        "y double, num_bookings long, star_rating string, star_rating_number int, avg_yield double, "
        "avg_adr double, scaled_x double, scaled_y double, scaled_star_rating_number double, scaled_avg_adr double"
    )
    pts = spark.createDataFrame(rows, schema)
    got = {(r[knn.TARGET_ID], r[knn.NEIGHBOUR_ID]): r for r in cs.comp_set_metrics(cs.comp_set(pts)).collect()}
    rank = {n: got[("t", n)]["compset_yield_performance_rank"] for n in "ntu"}
    assert rank == {"n": 1, "t": 2, "u": 3}  # NULL ratio ranks last
    assert got[("z", "z")]["compset_yield_vs_target_property_ratio"] is None  # zero target yield
    assert got[("t", "n")]["compset_share_of_bookings"] == pytest.approx(1 / 3)
    assert ("t", "z") not in got and ("z", "t") not in got


def _large_groups(spark):
    """Three groups the grid search must handle: clustered, all-duplicate-xy, and collinear."""
    rng = np.random.default_rng(11)
    groups = {
        # dense core plus sparse outskirts; coordinates on a 1/4 grid so distances are exact and tie
        "big": np.concatenate([rng.normal(0, 0.5, (1500, 4)), rng.uniform(-6, 6, (700, 4))]),
        # every point at the same (x, y): the grid cannot separate them
        "same_xy": np.column_stack([np.zeros(700), np.zeros(700), rng.normal(0, 1, (700, 2))]),
        # all on a line in (x, y)
        "line": np.column_stack([rng.uniform(0, 50, 900), np.zeros(900), rng.normal(0, 1, (900, 2))]),
    }
    rows = []
    for g, pts in groups.items():
        pts = np.round(pts * 4) / 4
        rows += [(g, f"{g}_{i:05d}", *map(float, p)) for i, p in enumerate(pts)]
    schema = "city_code string, harp_property_id_no string, f0 double, f1 double, f2 double, f3 double"
    return spark.createDataFrame(rows, schema), rows


def _numpy_knn(rows, k):
    out = {}
    by_group = {}
    for r in rows:
        by_group.setdefault(r[0], []).append(r)
    for g, rs in by_group.items():
        ids = np.array([r[1] for r in rs])
        x = np.array([r[2:] for r in rs])
        order_ids = np.argsort(ids)  # tie-break by id
        for i, r in enumerate(rs):
            d2 = ((x - x[i]) ** 2).sum(axis=1)
            idx = order_ids[np.lexsort((ids[order_ids], d2[order_ids]))][:k]
            out.update({(g, r[1], ids[j]): rank for rank, j in enumerate(idx, start=1)})
    return out


def test_knn_equals_brute_force_on_large_groups(spark):
    df, rows = _large_groups(spark)
    got = knn.knn_exact(df, ["f0", "f1", "f2", "f3"], k=10)
    assert _as_dict(got) == _numpy_knn(rows, 10)


def test_knn_of_many_equal_points(spark):
    """Equal points cost k rows of the pool, not their number squared."""
    df = spark.range(5000).select(
        F.lit("c").alias("city_code"),
        F.format_string("p%05d", "id").alias("harp_property_id_no"),
        F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(F.lit(1.0)).alias("f0"),
        F.lit(0.0).alias("f1"),
    )
    pool = knn.neighbour_pool(df, "city_code", "harp_property_id_no", ["f0", "f1"], 10)
    assert pool.count() == 50 + 10
    got = _as_dict(knn.knn_exact(df, ["f0", "f1"], k=10))
    assert len(got) == 50_000
    rows = [(r[0], r[1], r[2], r[3]) for r in df.collect()]
    some = [r for i, r in enumerate(rows) if i % 500 in (0, 7)]
    for city, pid, a, b in some:
        order = sorted(rows, key=lambda r: ((r[2] - a) ** 2 + (r[3] - b) ** 2, r[1]))[:10]
        assert [got[city, pid, r[1]] for r in order] == list(range(1, 11))


def test_knn_pairs_stay_few_in_a_clustered_city(spark):
    """20,000 points, 90% of them in a tight core: small leaves, and under 5% of all pairs."""
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 0.01, (18_000, 4)), rng.uniform(-50, 50, (2_000, 4))])
    import pandas as pd

    frame = pd.DataFrame(pts, columns=["f0", "f1", "f2", "f3"])
    frame.insert(0, "city_code", "c")
    frame.insert(1, "harp_property_id_no", [f"p{i:05d}" for i in range(len(frame))])
    df = spark.createDataFrame(frame)
    feats = ["f0", "f1", "f2", "f3"]
    pool = knn.neighbour_pool(df, "city_code", "harp_property_id_no", feats, 10)
    layout = knn.leaf_layout(pool, "city_code", 4, knn.LEAF_SIZE)
    sizes = layout.groupBy("city_code", "_leaf").count()
    leaves = sizes.agg(F.min("count"), F.max("count"), F.sum("count")).first()
    assert knn.LEAF_SIZE // 2 <= leaves[0] and leaves[1] <= knn.LEAF_SIZE and leaves[2] == 20_000
    pairs = knn.candidate_pairs(layout, layout.filter("_place = 1"), "city_code", 4, 10)
    assert pairs < 0.05 * 20_000**2


def test_one_point_per_property_when_names_tie(spark):
    # p2 has two current names (tie on the latest date): the search gets one point, most bookings first
    props = properties.property_metrics(_bookings(spark))
    pts = {r["harp_property_id_no"]: r["hotel_name"] for r in cs.one_row_per_property(props).collect()}
    assert sorted(pts) == ["p1", "p2", "p3"]
    assert pts["p2"] == "X"  # equal bookings -> smallest name


def test_report_columns_and_vectors(spark):
    report = cs.comp_set_report(fx.fixture_bookings(spark, SF_SMALL))
    assert report.columns == [*cs.REPORT_COLUMNS, "city_code"]
    rows = report.filter(F.col(knn.TARGET_ID) == F.col(knn.NEIGHBOUR_ID)).collect()
    assert rows
    for r in rows[:50]:
        assert r["knn_distance_metric"] == 0.0 and r["distance_km"] == 0.0
        assert r["features"] == [r["longitude"], r["latitude"], float(r["star_rating_number"]), r["avg_adr"]]
        assert len(r["scaledFeatures"]) == 4
        assert r["target_property_name"] == r["hotel_name"]


def _hot_city_points(spark):
    """Fixture hotels with a third of them moved into one city (the skew case)."""
    b = fx.fixture_bookings(spark, "/root/testdata/sf0.01")
    hot = F.when(F.pmod(F.xxhash64("harp_property_id_no"), F.lit(3)) == 0, F.lit("HOT")).otherwise(F.col("city_code"))
    return cs.prepare_points(properties.property_metrics(b.withColumn("city_code", hot)))


def test_hot_city_equals_brute_force(spark):
    from innsight.operators.features import FEATURES, scaled_name

    pts = _hot_city_points(spark).cache()
    sizes = {r["city_code"]: r["count"] for r in pts.groupBy("city_code").count().collect()}
    assert sizes["HOT"] > 3 * max(v for c, v in sizes.items() if c != "HOT")
    feats = [scaled_name(f) for f in FEATURES]
    rows = [tuple(r) for r in pts.select("city_code", "harp_property_id_no", *feats).collect()]
    assert _as_dict(knn.knn_exact(pts, feats, k=10)) == _numpy_knn(rows, 10)
    pts.unpersist()


def test_report_with_ml_vectors(spark):
    from pyspark.ml.linalg import DenseVector

    report = cs.comp_set_report(fx.fixture_bookings(spark, SF_SMALL), vectors=True)
    r = report.first()
    assert isinstance(r["features"], DenseVector) and isinstance(r["scaledFeatures"], DenseVector)
    assert r["features"][0] == r["longitude"]


def test_knn_lsh_recall_on_a_large_group(spark):
    df, rows = _large_groups(spark)
    big = df.filter("city_code = 'big'")
    approx = _as_dict(knn.knn_lsh(big, ["f0", "f1", "f2", "f3"], k=10))
    exact = _numpy_knn([r for r in rows if r[0] == "big"], 10)
    assert len(approx) == len(exact)
    assert len(set(exact) & set(approx)) / len(exact) >= 0.9


def test_knn_lsh_completes_short_targets(spark):
    """With buckets far too small, most targets are short and get the exact answer."""
    df, rows = _points(spark)
    got = _as_dict(knn.knn_lsh(df, ["f0", "f1", "f2"], k=10, bucket_candidates=1, num_hash_tables=1))
    per_target = {}
    for city, target, _ in got:
        per_target[city, target] = per_target.get((city, target), 0) + 1
    sizes = {c: sum(1 for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    assert len(per_target) == len(rows)
    assert all(n == min(10, sizes[city]) for (city, _), n in per_target.items())
