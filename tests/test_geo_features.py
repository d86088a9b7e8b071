"""Haversine, coordinate cleansing and per-city scaling."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from innsight.functions.columns import haversine_km
from innsight.operators import features as feat
from innsight.operators import geo


def test_haversine_known_distances(spark):
    def by_vectors(lat_a, lon_a, lat_b, lon_b):
        """The same distance another way: the angle between unit vectors."""
        a, b = (
            (math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)),
             math.sin(math.radians(la)))
            for la, lo in ((lat_a, lon_a), (lat_b, lon_b))
        )
        cross = math.hypot(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        return 6371.0 * math.atan2(cross, sum(x * y for x, y in zip(a, b)))

    half_turn = math.pi * 6371.0
    rows = [  # (lat_a, lon_a, lat_b, lon_b, km)
        (90.0, 17.0, -90.0, -120.0, half_turn),  # pole to pole, whatever the longitudes
        (90.0, 0.0, 0.0, 45.0, half_turn / 2),  # pole to equator
        (10.0, 179.5, 10.0, -179.5, by_vectors(10.0, 179.5, 10.0, -179.5)),  # across the date line
        (25.0, 40.0, -25.0, -140.0, half_turn),  # an antipode
        (52.5200, 13.4050, 48.8566, 2.3522, by_vectors(52.5200, 13.4050, 48.8566, 2.3522)),  # Berlin, Paris
        (35.6762, 139.6503, -33.8688, 151.2093, by_vectors(35.6762, 139.6503, -33.8688, 151.2093)),  # Tokyo, Sydney
        (None, 0.0, 0.0, 0.0, None),
    ]
    df = spark.createDataFrame(rows, "la double, oa double, lb double, ob double, want double")
    for r in df.select(haversine_km("la", "oa", "lb", "ob").alias("km"), "want").collect():
        assert r["km"] == (None if r["want"] is None else pytest.approx(r["want"], rel=1e-7))


def test_haversine_is_clamped_near_antipodes(spark):
    df = spark.range(2000).select(
        (F.rand(1) * 180 - 90).alias("la"), (F.rand(2) * 360 - 180).alias("oa")
    ).select("la", "oa", (-F.col("la")).alias("lb"), (F.col("oa") + 180).alias("ob"))
    km = df.select(haversine_km("la", "oa", "lb", "ob").alias("km")).collect()
    assert all(r["km"] is not None and not math.isnan(r["km"]) for r in km)
    assert max(r["km"] for r in km) <= math.pi * 6371.0 + 1e-6


SIZES = [1, 2, 3, 10, 33, 34, 50, 66, 67, 100, 101, 133, 200, 300, 400, 700, 1000, 1100]


@pytest.mark.parametrize("n", SIZES)
def test_percentile_bounds_equal_exact_quantile(spark, n):
    # distinct values 0..n-1 shuffled into x, all in one city; y constant
    df = spark.range(n).select(
        F.lit("c").alias("city_code"), (F.col("id") * 0.01 - 5).alias("x"), F.lit(1.0).alias("y")
    )
    b = geo.coordinate_bounds(df, "x").collect()[0]
    lo, hi = df.select("x").distinct().approxQuantile("x", [0.03, 0.97], 0.0)
    assert (b["x_lo"], b["x_hi"]) == (lo, hi)


def test_geo_clean_bounds_per_city_and_invalid_rows(spark):
    rows = [("a", float(i), 10.0) for i in range(100)] + [("b", 500.0, 10.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)]
    rows += [("c", 200.0, 0.0)]  # no valid coordinate at all -> city dropped
    df = spark.createDataFrame(rows, "city_code string, x double, y double")
    kept = geo.geo_clean(df)
    a = sorted(r["x"] for r in kept.filter("city_code = 'a'").collect())
    lo, hi = df.filter("city_code = 'a'").select("x").distinct().approxQuantile("x", [0.03, 0.97], 0.0)
    assert (a[0], a[-1]) == (lo, hi) and len(a) == int(hi - lo) + 1
    b = sorted(r["x"] for r in kept.filter("city_code = 'b'").collect())
    assert b == [1.0, 2.0]  # invalid 500.0 neither counts for bounds nor survives
    assert kept.filter("city_code = 'c'").count() == 0


def test_scaling_matches_ml_standard_scaler(spark):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.range(50).select(
        F.lit("c").alias("city_code"),
        F.col("id").cast("string").alias("harp_property_id_no"),
        (F.rand(3) * 10).alias("x"), (F.rand(4) * 5).alias("y"),
        (F.col("id") % 5 + 1).cast("int").alias("star_rating_number"), (F.rand(5) * 300).alias("avg_adr"),
    )
    ours = feat.scale_features(df)
    vec = VectorAssembler(inputCols=feat.FEATURES, outputCol="f").transform(df)
    ml = StandardScaler(inputCol="f", outputCol="s").fit(vec).transform(vec)
    ml = ml.select("harp_property_id_no", vector_to_array("s").alias("s"))
    joined = ours.join(ml, "harp_property_id_no").collect()
    for r in joined:
        for i, f in enumerate(feat.FEATURES):
            assert abs(r[feat.scaled_name(f)] - r["s"][i]) < 1e-12


def test_scaling_zero_variance_single_row_and_null(spark):
    rows = [
        ("one", "p1", 1.0, 2.0, 3, 100.0),  # one-hotel city: std undefined -> 0.0
        ("flat", "p2", 1.0, 2.0, 3, 100.0),
        ("flat", "p3", 1.0, 4.0, 3, 100.0),  # only y varies
        ("flat", "p4", 1.0, 2.0, None, 100.0),  # null feature: left out
    ]
    df = spark.createDataFrame(
        rows, "city_code string, harp_property_id_no string, x double, y double, star_rating_number int, avg_adr double"
    )
    got = {r["harp_property_id_no"]: r for r in feat.scale_features(df).collect()}
    assert set(got) == {"p1", "p2", "p3"}
    assert [got["p1"][feat.scaled_name(f)] for f in feat.FEATURES] == [0.0, 0.0, 0.0, 0.0]
    assert got["p2"]["scaled_x"] == 0.0 and got["p2"]["scaled_avg_adr"] == 0.0
    assert got["p3"]["scaled_y"] == pytest.approx(4.0 / math.sqrt(2.0))


def test_bounds_equal_per_city_quantile_loop_on_fixture(spark):
    """The one-pass bounds equal the source job's per-city ``approxQuantile(..., 0)`` loop."""
    from innsight.operators import properties
    from innsight.sources import fixtures as fx

    props = properties.property_metrics(fx.fixture_bookings(spark, "/root/testdata/sf0.001")).cache()
    ours = {r["city_code"]: (r["x_lo"], r["x_hi"], r["y_lo"], r["y_hi"]) for r in geo.geo_bounds(props).collect()}
    cities = [r[0] for r in props.select("city_code").distinct().collect()]
    assert len(cities) > 10
    for city in cities:  # test-only driver loop: the reference shape being checked against
        valid = props.filter((F.col("city_code") == city) & F.expr("x between -180 and 180 and y between -90 and 90"))
        qx = valid.select("x").distinct().approxQuantile("x", [0.03, 0.97], 0.0)
        qy = valid.select("y").distinct().approxQuantile("y", [0.03, 0.97], 0.0)
        assert ours[city] == (qx[0], qx[1], qy[0], qy[1]), city
    props.unpersist()


@pytest.mark.parametrize("accuracy", [geo.SKETCH_ACCURACY, 3])  # 3: a sketch that is far off
def test_select_ranks_equals_sorting(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {
        "heavy": np.unique(np.concatenate([rng.standard_cauchy(3000), [1e9, -1e9]])),  # tails stretch the bins
        "tight": np.unique(rng.normal(0, 1e-6, 800)),
        "tiny": np.array([3.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    values = spark.createDataFrame(rows, "city_code string, _v double")
    wanted = []
    for g, vs in groups.items():
        for j, r in enumerate({1, len(vs), max(1, len(vs) // 3), max(1, (len(vs) * 97) // 100)}):
            wanted.append((g, f"t{j}", int(r), float(np.sort(vs)[r - 1])))
    targets = spark.createDataFrame([(g, w, r) for g, w, r, _ in wanted], "city_code string, _which string, _rank long")
    got = {(r["city_code"], r["_which"]): r["_v"] for r in geo.select_ranks(values, targets, ["city_code"], accuracy).collect()}
    assert got == {(g, w): v for g, w, _, v in wanted}


def test_left_out_rows_are_counted(spark):
    rows = [("a", 1.0, 1.0, 3, 9.0), ("a", 1.0, None, 3, 9.0), ("a", 1.0, 2.0, None, None), ("b", 1.0, 1.0, 3, 9.0)]
    df = spark.createDataFrame(rows, "city_code string, x double, y double, star_rating_number int, avg_adr double")
    got = {r["city_code"]: (r["property_rows"], r["left_out"]) for r in feat.left_out_rows(df).collect()}
    assert got == {"a": (3, 2), "b": (1, 0)}
