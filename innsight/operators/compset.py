"""Competitive sets: each hotel's k nearest hotels in its city, with metrics.

End to end (``comp_set_report``), without a per-city loop:

    bookings -> property_metrics          (one row per property name and location, C8)
             -> geo_clean                 (per-city coordinate tails trimmed)
             -> scale_features            (per-city std scaling)
             -> one_row_per_property      (one row per city and property)
             -> knn_exact                 (k nearest in the city, target included)
             -> comp_set_metrics          (yield / booking comparisons and ranks)
             -> distance_km, final columns

Every step that the source job ran inside one city at a time carries
``city_code`` in its keys (grouping, join and window partitions), so no pair,
share or rank ever mixes two cities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import REPORT_COLUMNS
from innsight.functions.columns import safe_ratio
from innsight.operators.features import FEATURES, feature_arrays, scale_features, scaled_name
from innsight.operators.geo import DEFAULT_LOWER, DEFAULT_UPPER, geo_clean, with_distance_km
from innsight.operators.knn import DEFAULT_K, NEIGHBOUR_ID, TARGET_ID, attach, knn_exact, knn_lsh
from innsight.operators.properties import PROPERTY_ID, property_metrics
from innsight.plans.lineage import cut_lineage

CITY = "city_code"


TARGET_ATTRIBUTES = {
    "hotel_name": "target_property_name",
    "avg_yield": "target_property_yield",
    "num_bookings": "target_property_num_bookings",
    "x": "target_property_longitude",
    "y": "target_property_latitude",
}


def one_row_per_property(props: DataFrame) -> DataFrame:
    """One row per (city, property): most bookings, then smallest name, chain, x, y.

    A property can have several current names (ties on the latest date) or
    locations; the neighbour search needs one point per property.
    """
    order = Window.partitionBy(CITY, PROPERTY_ID).orderBy(
        F.col("num_bookings").desc(), "hotel_name", "hotel_chain_name", "x", "y"
    )
    return props.withColumn("_pick", F.row_number().over(order)).filter(F.col("_pick") == 1).drop("_pick")


def prepare_points(
    props: DataFrame, lo: float = DEFAULT_LOWER, hi: float = DEFAULT_UPPER, materialize: bool = False
) -> DataFrame:
    """Coordinate-cleaned, feature-scaled properties, then one row per property (``scaled_<feature>`` columns).

    Bounds and deviations are taken over all property rows, as in the source
    job; only the search needs one row per property, so of a hotel with several
    locations the best one among the *clean* rows stays.

    ``materialize`` cuts the lineage first: the cleaning and the scaling read
    the properties several times (bounds, the rows themselves, the deviations),
    and each read would otherwise re-run whatever produced ``props`` -- for
    ``property_metrics`` a pass over all bookings.
    """
    props = cut_lineage(props.filter(F.col(CITY).isNotNull()), enabled=materialize, label="properties")
    return one_row_per_property(scale_features(geo_clean(props, lo, hi), FEATURES))


def comp_set(points: DataFrame, k: int = DEFAULT_K, method: str = "exact", **knn_options) -> DataFrame:
    """Target x neighbour pairs with the neighbour's attributes and the target's.

    ``method`` is ``"exact"`` or ``"lsh"`` (approximate). Output columns:
    ``city_code``, the knn columns, every point column of the neighbour, and
    the ``target_property_*`` attributes.
    """
    scaled = [scaled_name(f) for f in FEATURES]
    search = knn_exact if method == "exact" else knn_lsh
    pairs = search(points, scaled, k=k, key=CITY, id_col=PROPERTY_ID, **knn_options)
    neighbour_cols = {c: c for c in points.columns if c not in (CITY, PROPERTY_ID)}
    pairs = attach(pairs, points, NEIGHBOUR_ID, neighbour_cols, CITY, PROPERTY_ID)
    return attach(pairs, points, TARGET_ID, TARGET_ATTRIBUTES, CITY, PROPERTY_ID)


def comp_set_metrics(pairs: DataFrame) -> DataFrame:
    """Yield and booking comparisons of each neighbour with its target, ranked within the set.

    * ``..._yield_vs_target_property_diff`` / ``_ratio``: neighbour minus / over target yield;
    * ``compset_yield_performance_rank``: dense rank of that ratio, highest first;
    * ``compset_share_of_bookings``: neighbour bookings over the set's total (target included);
    * ``compset_bookings_wrt_target_property_ratio`` and its dense rank, highest first.

    Ratios with a zero denominator are NULL and rank last.
    """
    in_set = Window.partitionBy(CITY, TARGET_ID)
    yield_ratio = safe_ratio("avg_yield", "target_property_yield")
    booking_ratio = safe_ratio("num_bookings", "target_property_num_bookings")
    out = pairs.withColumns(
        {
            "compset_yield_vs_target_property_diff": F.col("avg_yield") - F.col("target_property_yield"),
            "compset_yield_vs_target_property_ratio": yield_ratio,
            "compset_share_of_bookings": safe_ratio(
                "num_bookings", F.sum("num_bookings").over(in_set)
            ),
            "compset_bookings_wrt_target_property_ratio": booking_ratio,
        }
    )
    return out.withColumns(
        {
            "compset_yield_performance_rank": F.dense_rank().over(
                in_set.orderBy(F.col("compset_yield_vs_target_property_ratio").desc_nulls_last())
            ),
            "compset_share_of_bookings_rank": F.dense_rank().over(
                in_set.orderBy(F.col("compset_bookings_wrt_target_property_ratio").desc_nulls_last())
            ),
        }
    )


def report_columns(df: DataFrame, vectors: bool = False) -> DataFrame:
    """The report's 26 columns, then ``city_code``.

    ``features`` / ``scaledFeatures`` are ``array<double>``, or Spark ML dense
    vectors with ``vectors=True`` (converted by the JVM-side ``array_to_vector``).
    """
    df = with_distance_km(df, "y", "x", "target_property_latitude", "target_property_longitude")
    arrays = feature_arrays(FEATURES)
    if vectors:
        from pyspark.ml.functions import array_to_vector

        arrays = {name: array_to_vector(col) for name, col in arrays.items()}
    df = df.withColumns(arrays).withColumnsRenamed({"x": "longitude", "y": "latitude"})
    return df.select(*REPORT_COLUMNS, CITY)


def comp_set_report(
    bookings: DataFrame,
    k: int = DEFAULT_K,
    method: str = "exact",
    lo: float = DEFAULT_LOWER,
    hi: float = DEFAULT_UPPER,
    materialize: bool = True,
    vectors: bool = False,
    **knn_options,
) -> DataFrame:
    """Competitive-set report for every hotel of every city, from raw bookings.

    ``materialize`` writes the property rows and then the prepared points to the
    session's checkpoint folder: both are read several times, and without the
    cuts each read would re-run the aggregation of all bookings. The neighbour
    search always writes the levels of its tree. So jobs run while the report is
    built; what is returned is lazy from the search on.
    """
    points = prepare_points(property_metrics(bookings), lo, hi, materialize=materialize)
    points = cut_lineage(points, enabled=materialize, label="points")
    return comp_set_report_of_points(points, k, method, vectors, **knn_options)


def comp_set_report_of_points(
    points: DataFrame, k: int = DEFAULT_K, method: str = "exact", vectors: bool = False, **knn_options
) -> DataFrame:
    """The report from prepared points (``prepare_points``), which are read several times."""
    return report_columns(comp_set_metrics(comp_set(points, k, method, **knn_options)), vectors=vectors)
