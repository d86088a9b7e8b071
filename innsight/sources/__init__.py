"""Readers for the search log, rate lookup and bookings, plus test-table adapters."""

from innsight.sources.bookings import (
    BOOKING_COLUMNS,
    read_bookings_parquet,
    read_bookings_sql,
    read_bookings_sql_file,
    read_bookings_table,
)
from innsight.sources.search_log import (
    DATE_PARTS,
    LABEL_TYPE,
    LABELS_COLUMN,
    SEARCH_LOG_SCHEMA,
    SearchWindow,
    read_rate_lookup,
    read_search_log,
    read_search_log_checked,
)

__all__ = [
    "BOOKING_COLUMNS",
    "DATE_PARTS",
    "LABELS_COLUMN",
    "LABEL_TYPE",
    "SEARCH_LOG_SCHEMA",
    "SearchWindow",
    "read_bookings_parquet",
    "read_bookings_sql",
    "read_bookings_sql_file",
    "read_bookings_table",
    "read_rate_lookup",
    "read_search_log",
    "read_search_log_checked",
]
