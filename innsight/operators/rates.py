"""Rate frequency: how often each rate bucket / rate type / top-3 flag is returned.

Plan of ``rate_frequency`` (one lazy DataFrame, two shuffles):

1. window filter on the date partition columns (directory pruning) and a
   projection of the seven needed columns (column pruning);
2. left join to the rate lookup, broadcast behind a check of its bytes (else a
   join with frequent and null ids apart), with unmatched rates bucketed as
   ``OTHER``;
3. drop rates with no qualifying label (narrow, before any shuffle);
4. de-duplicate (date, session, hotel, rate, bucket, labels) -- partial
   de-duplication map-side, then a hash exchange on all those keys, so a hot
   session or hotel is still spread by rate id and labels;
5. read rank and type out of the label array (narrow) and count rates per
   (date, session, hotel, bucket, type, flag) -- partial counts map-side, so the
   second exchange carries at most one row per group per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import (
    FREQUENCY_KEYS,
    LABELS_COLUMN,
    RATE_ROW_KEYS,
    SESSION_KEYS,
    SUMMARY_KEYS,
    UNMATCHED_RATE_BUCKET,
)
from innsight.operators.labels import (
    keep_rates_with_qualifying_labels,
    with_label_columns,
    with_top3_flag,
)
from innsight.plans.joins import DEFAULT_MAX_BROADCAST_BYTES, join_bounded
from innsight.plans.lineage import cut_lineage
from innsight.sources.search_log import SearchWindow


def select_window(log: DataFrame, window: SearchWindow | None) -> DataFrame:
    """Rows of the window with the columns the analysis needs; ``id`` becomes ``rate_id``."""
    rows = log if window is None else log.filter(window.predicate())
    return rows.select(*SESSION_KEYS, F.col("id").alias("rate_id"), LABELS_COLUMN)


def attach_rate_bucket(
    rates: DataFrame, lookup: DataFrame, max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES
) -> DataFrame:
    """Left-join the lookup on ``rate_id``; rates missing from it get bucket ``OTHER``.

    A lookup of at most ``max_broadcast_bytes`` measured bytes is broadcast. To a
    larger one the rates are shuffled by id, without the null ids (which are
    ``OTHER``) and the frequent ones (whose few lookup rows are broadcast), so no
    task gets more than its share.
    """
    side = lookup.select("rate_id", "new_rate_bucket")
    joined = join_bounded(rates, side, on="rate_id", how="left", max_bytes=max_broadcast_bytes)
    return joined.withColumn(
        "new_rate_bucket", F.coalesce(F.col("new_rate_bucket"), F.lit(UNMATCHED_RATE_BUCKET))
    )


def distinct_rates(rates: DataFrame) -> DataFrame:
    """One row per distinct (date, session, hotel, rate, bucket, labels)."""
    return rates.select(*RATE_ROW_KEYS).distinct()


def rate_frequency(
    log: DataFrame,
    lookup: DataFrame,
    window: SearchWindow | None = None,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    checkpoint: bool = False,
) -> DataFrame:
    """Number of distinct rates returned per date, session, hotel, bucket, type and top-3 flag.

    Output: ``year, month, day, res_sessionID, hotel_id, new_rate_bucket,
    CWT_RATE_TYPE, top3_rate_flag, responses`` (bigint). ``checkpoint`` cuts the
    lineage after de-duplication (useful when the log's plan is very long).
    """
    rates = attach_rate_bucket(select_window(log, window), lookup, max_broadcast_bytes)
    unique = distinct_rates(keep_rates_with_qualifying_labels(rates))
    unique = cut_lineage(unique, enabled=checkpoint)
    flagged = with_top3_flag(with_label_columns(unique))
    return flagged.groupBy(*FREQUENCY_KEYS).agg(F.count(F.lit(1)).alias("responses"))


def rate_summary(frequency: DataFrame) -> DataFrame:
    """Total responses per date, rate type and top-3 flag (``total_responses``)."""
    return frequency.groupBy(*SUMMARY_KEYS).agg(F.sum("responses").alias("total_responses"))
