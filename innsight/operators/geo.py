"""Coordinate cleansing per city and great-circle distance.

``geo_clean`` trims the long tails of each city's longitudes and latitudes: the
bounds are the exact discrete percentiles (``lo`` and ``hi``) of the *distinct*
coordinate values among the city's rows with valid coordinates, taken for
``x`` and ``y`` independently, and a row is kept when both of its coordinates
lie inside them (inclusive).

All cities are handled together: the bounds come from an exact rank
selection over the distinct coordinates (``select_ranks``), which sorts only the
few values that a quantile sketch leaves in question, and are joined back to the
rows. A city without any valid coordinate has no bounds row and so keeps no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import PERCENTILE_LOWER, PERCENTILE_UPPER
from innsight.functions.columns import haversine_km, valid_coordinates

CITY = "city_code"
DEFAULT_LOWER, DEFAULT_UPPER = PERCENTILE_LOWER, PERCENTILE_UPPER
SKETCH_ACCURACY = 10_000  # a sketched rank is off by at most 1 / SKETCH_ACCURACY of the values
CUTS = 1_000  # quantiles read from a sketch


def disc_rank(p: float, n: Column) -> Column:
    """1-based position of the discrete ``p`` percentile among ``n`` sorted values: ``max(1, ceil(p * n))``."""
    return F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n)).cast("long")


def select_ranks(
    values: DataFrame, targets: DataFrame, keys: list[str], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """The value at a given rank of each group's sorted distinct values, without sorting a group.

    ``values``: ``keys + [_v]``, distinct. ``targets``: ``keys + [_which, _rank]``
    (1-based ranks). Returns ``keys + [_which, _v]``.

    A quantile sketch per group (``percentile_approx``, merged from partial
    sketches) is off by at most 1 / ``accuracy`` of the group, so two of its
    values bracket the wanted rank. One aggregate counts the values below and
    inside the bracket; only what lies inside is sorted, a few thousandths of a
    group. Where the counts show that the rank is not inside, the
    bracket is the whole group: the result is exact whatever the sketch says.
    Nothing is written; Spark reuses the shuffle that made the values distinct.
    """
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    margin = 2.0 / accuracy
    wanted = targets.join(sizes, keys)
    share = lambda by: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_rank") - 1) / F.col("_n") + by))
    wanted = wanted.select(*keys, "_which", "_rank", share(-margin).alias("_from"), share(margin).alias("_to"))
    # the sketch gives all of its cuts once, whatever ranks are asked for
    at = [c / CUTS for c in range(CUTS + 1)]
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", at, accuracy).alias("_cuts"))
    place = lambda c, up: F.element_at("_cuts", (up(F.col(c) * CUTS) + 1).cast("int"))
    brackets = wanted.join(cuts, keys).select(
        *keys, "_which", "_rank", place("_from", F.floor).alias("_low"), place("_to", F.ceil).alias("_high")
    )
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    counted = values.join(brackets, keys).groupBy(*keys, "_which").agg(
        F.max("_rank").alias("_rank"),
        F.max("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.sum((F.col("_v") < F.col("_low")).cast("long")).alias("_below"),
        F.sum(inside.cast("long")).alias("_inside"),
    )
    held = (F.col("_rank") > F.col("_below")) & (F.col("_rank") <= F.col("_below") + F.col("_inside"))
    counted = counted.select(
        *keys,
        "_which",
        F.when(held, F.col("_rank") - F.col("_below")).otherwise(F.col("_rank")).alias("_rank"),
        F.when(held, F.col("_low")).alias("_low"),
        F.when(held, F.col("_high")).alias("_high"),
    )
    few = values.join(counted, keys).filter(F.col("_low").isNull() | inside)
    order = Window.partitionBy(*keys, "_which").orderBy("_v")
    return few.withColumn("_place", F.row_number().over(order)).filter("_place = _rank").select(*keys, "_which", "_v")


def _bounds(props: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    valid = props.filter(valid_coordinates("x", "y") & F.col(CITY).isNotNull())
    # one selection for all coordinates: (city, coordinate) is the group
    values = None
    for c in cols:
        part = valid.select(CITY, F.lit(c).alias("_dim"), F.col(c).cast("double").alias("_v"))
        values = part if values is None else values.unionByName(part)
    values = values.distinct()
    keys = [CITY, "_dim"]
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    targets = n.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("lo").alias("_which"), disc_rank(lo, F.col("_n")).alias("_rank")),
                F.struct(F.lit("hi").alias("_which"), disc_rank(hi, F.col("_n")).alias("_rank")),
            )
        ).alias("_t"),
    ).select(*keys, "_t._which", "_t._rank")
    picked = select_ranks(values, targets, keys)
    return picked.groupBy(CITY).agg(
        *[
            F.max(F.when((F.col("_dim") == c) & (F.col("_which") == w), F.col("_v"))).alias(f"{c}_{w}")
            for c in cols
            for w in ("lo", "hi")
        ]
    )


def coordinate_bounds(
    props: DataFrame, col: str, lo: float = DEFAULT_LOWER, hi: float = DEFAULT_UPPER
) -> DataFrame:
    """Per city, the ``lo`` / ``hi`` discrete percentiles of the distinct values of ``col``.

    Only rows with valid coordinates (longitude in [-180, 180], latitude in
    [-90, 90]) and a city count. Columns: ``city_code, {col}_lo, {col}_hi``.
    Equal to ``percentile_disc`` over the distinct values (the value at
    position ``max(1, ceil(p * n))``), computed by ``select_ranks`` so that a
    city's coordinates are never gathered into one task.
    """
    return _bounds(props, [col], lo, hi)


def geo_bounds(props: DataFrame, lo: float = DEFAULT_LOWER, hi: float = DEFAULT_UPPER) -> DataFrame:
    """Per city: ``x_lo, x_hi, y_lo, y_hi`` (one row per city with a valid coordinate).

    The two coordinates are ranked independently, in one selection.
    """
    return _bounds(props, ["x", "y"], lo, hi)


def geo_clean(
    props: DataFrame,
    lo: float = DEFAULT_LOWER,
    hi: float = DEFAULT_UPPER,
) -> DataFrame:
    """Rows of ``props`` whose ``x`` and ``y`` lie within their city's bounds (inclusive)."""
    bounds = geo_bounds(props, lo, hi)
    # The bounds side is an aggregate (one row per city): AQE measures it and
    # broadcasts it when small; counting it up front would recompute ``props``.
    joined = props.join(bounds, on=CITY, how="inner")
    inside = F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(
        F.col("y_lo"), F.col("y_hi")
    )
    return joined.filter(inside).drop("x_lo", "x_hi", "y_lo", "y_hi")


def with_distance_km(
    df: DataFrame, lat_a: str, lon_a: str, lat_b: str, lon_b: str, out: str = "distance_km"
) -> DataFrame:
    """Add the great-circle distance between two points (degrees) in km."""
    return df.withColumn(out, haversine_km(lat_a, lon_a, lat_b, lon_b))
