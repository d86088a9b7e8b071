"""Name -> query and name -> DuckDB oracle, for the driver and the tests.

Every query takes ``(spark, sf_dir)``, derives its inputs from the driver's
tables with Spark (``sources.fixtures``) and returns a DataFrame. Queries that
cut their lineage run jobs while they are built; the rest is lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innsight.queries import compset as compset_queries
from innsight.queries import rates as rate_queries
from innsight.queries import round_trips

Query = Callable[[SparkSession, str], DataFrame]

_RATE_QUERIES = [
    "scan_search_log",
    "scan_rate_lookup",
    "search_window_filter",
    "search_projection",
    "rate_bucket_join",
    "distinct_rates",
    "qualifying_labels",
    "label_explode",
    "label_pivot",
    "top3_flag",
    "rate_frequency",
    "rate_summary",
]

_COMPSET_QUERIES = [
    "bookings_since",
    "current_property_names",
    "bookings_current_name",
    "star_rating_filter",
    "star_rating_number",
    "property_metrics",
    "property_metrics_by_join",
    "distinct_cities",
    "geo_bounds",
    "geo_clean",
    "scaled_features",
    "left_out_rows",
    "knn_exact",
    "knn_exact_salted",
    "knn_exact_grid",
    "knn_lsh",
    "haversine_distance",
    "compset_metrics",
    "compset_yield_rank",
    "compset_booking_share",
    "compset_output",
]


_ROUND_TRIPS = [
    "log_read_window",
    "log_read_checked",
    "lookup_read",
    "rate_job_output",
    "rate_job_summary",
    "frequency_single_csv",
    "bookings_read_sql",
    "bookings_read_table",
    "properties_by_city",
    "properties_csv",
    "lineage_cut",
]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: getattr(rate_queries, name) for name in _RATE_QUERIES}
    out.update({name: getattr(compset_queries, name) for name in _COMPSET_QUERIES})
    out.update({name: getattr(round_trips, name) for name in _ROUND_TRIPS})
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(rate_queries.ORACLE)
    out.update(compset_queries.ORACLE)
    out.update(round_trips.ORACLE)
    return {name: out[name] for name in queries() if name in out}
