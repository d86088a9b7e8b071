"""Booking (transaction) sources for the competitive-set analysis.

The bookings contract, one row per booking:

============================  =========================================
column                        meaning
============================  =========================================
``harp_property_id_no``       property id (string)
``hotel_name``                name at booking time
``hotel_chain_name``          chain
``city_code``                 city the property belongs to
``x`` / ``y``                 longitude / latitude in degrees (double)
``created_date``              booking date (date or timestamp)
``star_rating``               text whose first character is the star count
``yield`` / ``adr``           yield and average daily rate (double)
============================  =========================================

Bookings may come from Parquet files, a catalog table, or a SQL query against
the catalog; all three give the same lazy DataFrame so filters and column
pruning still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOOKING_COLUMNS = [
    "harp_property_id_no",
    "hotel_name",
    "hotel_chain_name",
    "city_code",
    "x",
    "y",
    "created_date",
    "star_rating",
    "yield",
    "adr",
]


def read_bookings_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bookings from Parquet files (schema from the footers)."""
    return spark.read.parquet(path)


def read_bookings_table(spark: SparkSession, table: str) -> DataFrame:
    """Bookings from a catalog table."""
    return spark.table(table)


def read_bookings_sql(spark: SparkSession, sql_text: str) -> DataFrame:
    """Bookings from a SQL query over the catalog (the query text is a parameter)."""
    return spark.sql(sql_text)


def read_bookings_sql_file(spark: SparkSession, sql_path: str) -> DataFrame:
    """Bookings from a SQL text file, in any store Spark reads."""
    return read_bookings_sql(spark, spark.read.text(sql_path, wholetext=True).first()[0])
