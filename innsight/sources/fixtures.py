"""Adapters from the driver's test tables onto this package's input contracts.

The test data (``TESTDATA.md``) is a TPC-H-like schema plus an ``events`` log.
These functions derive, with Spark, a search-response log, a rate lookup and a
bookings table of the shapes the operators expect, so every registered query
reads the given tables and its work grows with them. The mapping rules are
documented in ``FIXTURES.md`` §2.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.columns import RATE_SORTED_RANK_LABEL, RATE_TYPE_LABEL
from innsight.sources.search_log import LABEL_TYPE, LABELS_COLUMN, SearchWindow

# --- fixed values of the fixture mapping (FIXTURES.md §2) ------------------
HOTELS_PER_LOG = 40  # hotel_id = event_id % 40
EVENTS_PER_RATE = 4  # rate id = event_id div 4: about 1.25 rate ids per part, so a fifth fall to OTHER
RANK_MODULUS = 7  # rank label value = k % 7
# Window of the fixture log (events span January 2024).
FIXTURE_WINDOW = SearchWindow(datetime.date(2024, 1, 24), datetime.date(2024, 1, 30))
# Bookings date lower bound used by the date-filter query (orders span 1995-2001).
FIXTURE_BOOKINGS_SINCE = "1998-01-01"
# ---------------------------------------------------------------------------


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _label(label_id, label_type, value) -> F.Column:
    return F.struct(
        label_id.cast("string").alias("id"),
        label_type.cast("string").alias("type"),
        value.cast("string").alias("value"),
    )


def search_log_from_events(events: DataFrame, window: SearchWindow | None = None) -> DataFrame:
    """Search-response log (``SEARCH_LOG_SCHEMA``) derived from ``events``.

    With ``window`` the event-time range is filtered first, which Spark pushes
    into the Parquet scan (the stand-in for directory pruning on a real log).
    """
    if window is not None:
        # bounds as literals of the column's own type, written as text, so the
        # range means the same wall-clock days whatever the session time zone
        ts_type = events.schema["ts"].dataType.simpleString()
        start, end = (F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast(ts_type) for t in window.timestamp_bounds())
        events = events.filter((F.col("ts") >= start) & (F.col("ts") < end))
    k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
    none = F.lit(None)
    rank_label = F.lit(RATE_SORTED_RANK_LABEL)
    type_label = F.lit(RATE_TYPE_LABEL)
    labels = (
        F.when(k.isNull(), F.lit(None).cast(T.ArrayType(LABEL_TYPE)))
        .when(k % 10 == 0, F.array(_label(none, none, none)))
        .when(k % 10 == 1, F.array(_label(type_label, F.lit("OTHER"), F.col("event_type"))))
        .when(k % 10 == 2, F.array().cast(T.ArrayType(LABEL_TYPE)))
        .otherwise(
            F.array(
                _label(rank_label, rank_label, k % RANK_MODULUS),
                _label(type_label, type_label, F.col("event_type")),
            )
        )
    )
    return events.select(
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.col("user_id").cast("string").alias("res_sessionID"),
        (F.col("event_id") % HOTELS_PER_LOG).cast("string").alias("hotel_id"),
        F.when(k.isNotNull(), F.expr(f"event_id div {EVENTS_PER_RATE}")).cast("string").alias("id"),
        labels.alias(LABELS_COLUMN),
    )


def rate_lookup_from_part(part: DataFrame) -> DataFrame:
    """Rate lookup (one row per ``rate_id``): every part."""
    return part.select(
        F.col("p_partkey").cast("string").alias("rate_id"),
        F.col("p_type").alias("new_rate_bucket"),
    )


def bookings_from_tpch(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Bookings (``BOOKING_COLUMNS``): one per order, the customer playing the hotel.

    The hotel name carries the order status, so a property's name changes over
    time (and ties on the latest date occur); the nation is the city; the
    order priority ('1-URGENT' .. '5-LOW') is the star-rating text.
    """
    custkey = F.col("c_custkey")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        custkey.cast("string").alias("harp_property_id_no"),
        F.concat(F.col("c_name"), F.lit("/"), F.col("o_orderstatus")).alias("hotel_name"),
        F.col("c_mktsegment").alias("hotel_chain_name"),
        F.col("c_nationkey").cast("string").alias("city_code"),
        (((custkey * 7919) % 3600).cast("double") / 10 - 180).alias("x"),
        (((custkey * 104729) % 1800).cast("double") / 10 - 90).alias("y"),
        F.col("o_orderdate").alias("created_date"),
        F.col("o_orderpriority").alias("star_rating"),
        (F.col("o_totalprice") * 0.8).alias("yield"),
        F.col("o_totalprice").alias("adr"),
    )


def fixture_search_log(spark: SparkSession, sf_dir: str, window: SearchWindow | None = FIXTURE_WINDOW) -> DataFrame:
    return search_log_from_events(load_table(spark, sf_dir, "events"), window)


def fixture_rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_lookup_from_part(load_table(spark, sf_dir, "part"))


def fixture_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookings_from_tpch(load_table(spark, sf_dir, "orders"), load_table(spark, sf_dir, "customer"))
