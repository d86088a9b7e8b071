"""Rate labels: qualification, rank / type extraction, top-3 flag.

Two equivalent forms are provided.

* The **array form** (``with_label_columns``) reads the rank and type straight
  out of each row's label array with higher-order functions. It is narrow: no
  explode, no shuffle, and it is what ``rate_frequency`` uses.
* The **row form** (``explode_labels`` + ``pivot_labels``) explodes the labels,
  filters qualifying ones and pivots them back with ``first``; it is the
  textbook shape and is kept as a public operator and as a cross-check.

Both agree whenever each pivot group is one source row, which ``rate_frequency``
guarantees by de-duplicating before it reads labels. For duplicated labels the
array form takes the first qualifying non-null value in array order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.columns import (
    RATE_SORTED_RANK_LABEL,
    RATE_TYPE_LABEL,
    label_qualifies,
    label_value,
    qualifying_labels,
    top3_flag,
)
from innsight.sources.search_log import LABELS_COLUMN

_QUALIFIED = "_qualified_labels"


def keep_rates_with_qualifying_labels(df: DataFrame, labels: str = LABELS_COLUMN) -> DataFrame:
    """Rows with at least one qualifying label (null / empty arrays are dropped)."""
    return df.filter(F.size(qualifying_labels(labels)) > 0)


def with_label_columns(df: DataFrame, labels: str = LABELS_COLUMN) -> DataFrame:
    """Add ``CWT_RATE_TYPE`` and ``CWT_RATE_SORTED_RANK`` (string, may be NULL).

    Rows without any qualifying label are dropped, as an inner explode would.
    """
    return (
        df.withColumn(_QUALIFIED, qualifying_labels(labels))
        .filter(F.size(_QUALIFIED) > 0)
        .withColumns(
            {
                RATE_TYPE_LABEL: label_value(_QUALIFIED, RATE_TYPE_LABEL),
                RATE_SORTED_RANK_LABEL: label_value(_QUALIFIED, RATE_SORTED_RANK_LABEL),
            }
        )
        .drop(_QUALIFIED)
    )


def with_top3_flag(df: DataFrame, rank: str = RATE_SORTED_RANK_LABEL) -> DataFrame:
    """Add ``top3_rate_flag`` (int 1/0) from the rank text."""
    return df.withColumn("top3_rate_flag", top3_flag(rank))


def explode_labels(df: DataFrame, labels: str = LABELS_COLUMN) -> DataFrame:
    """One row per qualifying label: adds ``label_id`` and ``label_value``.

    ``explode`` drops null and empty arrays; a label qualifies when its id equals
    its type and is a known label id, or it is the array's only label and has a
    null id (a null element counts as such).
    """
    e = F.col("_label")
    return (
        df.withColumn("_label", F.explode(labels))
        .filter(label_qualifies(e, F.size(labels) == 1))
        .withColumn("label_id", e["id"])
        .withColumn("label_value", e["value"])
        .drop("_label")
    )


def pivot_labels(exploded: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Pivot exploded labels to one column per known label id (first non-null value)."""
    return (
        exploded.groupBy(*group_cols)
        .pivot("label_id", [RATE_TYPE_LABEL, RATE_SORTED_RANK_LABEL])
        .agg(F.first("label_value", ignorenulls=True))
    )
