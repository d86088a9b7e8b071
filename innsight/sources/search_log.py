"""Search-response log and rate lookup readers.

The log is Parquet laid out in ``year=/month=/day=`` directories. Reading it
with a declared schema keeps the partition columns as ``int`` and lets a filter
on them prune whole directories (``PartitionFilters`` in the scan); selecting a
few columns, or only the label fields used, prunes the rest of the file
(``ReadSchema``).
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.fixed_values import DATE_PARTS, LABEL_FIELDS, LABELS_COLUMN, SEARCH_LOG_FIELDS  # noqa: F401  (re-exported)
from innsight.sources.footers import read_fitting

LABEL_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in LABEL_FIELDS])
_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "labels": T.ArrayType(LABEL_TYPE)}
SEARCH_LOG_SCHEMA = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in SEARCH_LOG_FIELDS])


@dataclass(frozen=True)
class SearchWindow:
    """A run of days, both ends inclusive; may cross months and years."""

    first: datetime.date
    last: datetime.date

    def __post_init__(self) -> None:
        if self.first > self.last:
            raise ValueError(f"the window ends ({self.last}) before it begins ({self.first})")

    @classmethod
    def between(cls, first: str | None, last: str | None) -> SearchWindow | None:
        """The window of two ISO dates, None for none; one without the other is an error."""
        if (first is None) != (last is None):
            raise ValueError("a window needs its first and its last day")
        return cls(datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)) if first else None

    def predicate(self) -> Column:
        """Filter on the date partition columns (prunes directories), one term per month."""
        terms = []
        month = self.first.replace(day=1)
        while month <= self.last:
            following = (month + datetime.timedelta(days=31)).replace(day=1)
            start, end = max(self.first, month), min(self.last, following - datetime.timedelta(days=1))
            term = (F.col("year") == month.year) & (F.col("month") == month.month)
            terms.append(term & F.col("day").between(start.day, end.day))
            month = following
        out = terms[0]
        for term in terms[1:]:
            out = out | term
        return out

    def timestamp_bounds(self) -> tuple[datetime.datetime, datetime.datetime]:
        """``[start, end)`` as timestamps, for sources keyed by an event time."""
        start = datetime.datetime.combine(self.first, datetime.time())
        return start, datetime.datetime.combine(self.last, datetime.time()) + datetime.timedelta(days=1)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    """Parquet search log under ``year=/month=/day=`` directories, declared schema."""
    return spark.read.schema(SEARCH_LOG_SCHEMA).parquet(path)


def read_search_log_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The search log without the files that the declared schema does not fit, and those with the reason."""
    return read_fitting(spark, path, SEARCH_LOG_SCHEMA, DATE_PARTS)


def read_rate_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Rate lookup (``rate_id``, ``new_rate_bucket``), schema from the file footers."""
    return spark.read.parquet(path)
