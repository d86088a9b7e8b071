"""Join-strategy helpers.

Spark broadcasts a join side on its own when the optimizer's size estimate is
below ``spark.sql.autoBroadcastJoinThreshold``, and AQE re-plans a sort-merge
join as a broadcast join once a shuffle stage has measured the side as small.
For a side read straight from files the static estimate is the compressed file
size, which can be several times below the in-memory size. Where we *want* a
broadcast, the side's bytes are measured first (one aggregate, one row per
task). Where the side is too large for that, both sides meet by key:

* ``join_split`` keeps frequent keys and null keys out of that meeting. One
  aggregate with a frequent-items sketch names the keys that hold more than a
  task's fair share of the big side. The small side's rows of those keys are
  broadcast behind a check of their bytes (or dealt to salted copies of the key),
  rows with a null key are led round the join, and only the rest is shuffled.
* ``keep_possible_matches`` drops rows of the big side that have no partner
  before anything is shuffled, by a Bloom filter of the small side's keys. The
  filter's size is bounded; more keys than it is made for only let more rows
  pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a side we are willing to build on the driver and ship to every executor.
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES, FIELD_BYTES = 24, 16  # of a row in a hash table, besides texts
MAX_FREQUENT_KEYS = 1_000
SALTS = 16  # copies of a frequent key whose rows on the small side are too many to broadcast
BITS_PER_KEY, BITS_SET = 10, 4  # of the Bloom filter
BUCKET_BITS = 1 << 15  # of one bucket of the filter, kept as 64-bit words
MAX_BUCKETS = 4_096  # 16 MB


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of ``df`` in memory: rows, fields and the texts' own lengths."""
    width = ROW_BYTES + FIELD_BYTES * len(df.columns)
    texts = [F.col(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = F.lit(width)
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def _key_hash(on: Sequence[str]) -> Column:
    """A hash of the key, null where a part of it is null."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return F.when(whole, F.xxhash64(*on))


def frequent_keys(df: DataFrame, on: Sequence[str], max_keys: int = MAX_FREQUENT_KEYS) -> tuple[list[int], int]:
    """(hashes of frequent keys, rows with a null in the key).

    A key is frequent when it holds more than half of what a task would get of an
    even deal. The counts come from a frequent-items sketch of bounded size, so
    they may be a little high; which keys are named steers the plan only.
    """
    tracked = 8 * max_keys
    total, keyed, items = df.select(_key_hash(on).alias("_h")).agg(
        F.count(F.lit(1)), F.count("_h"), F.expr(f"approx_top_k(_h, {max_keys}, {tracked})")
    ).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = keyed / (2 * tasks)
    # the sketch counts nulls too
    return [i["item"] for i in items or [] if i["item"] is not None and i["count"] > least], total - keyed


def join_split(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    max_keys: int = MAX_FREQUENT_KEYS,
) -> DataFrame:
    """``big`` joined to ``small`` (inner or left) on equal columns, frequent and null keys apart from the rest.

    The same rows as ``big.join(small, on, how)``, repeated keys of ``small``
    included. Reads the key columns of ``big`` once more, for the sketch, and each
    part of ``big`` with its own pushed filter.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no split for a {how} join")
    on = [on] if isinstance(on, str) else list(on)
    columns = big.columns + [c for c in small.columns if c not in on]
    frequent, nulls = frequent_keys(big, on, max_keys)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    small = small.filter(whole)
    is_frequent = F.xxhash64(*on).isin(frequent) if frequent else F.lit(False)
    parts = [big.filter(whole & ~is_frequent).join(small.filter(~is_frequent), on, how)]
    if frequent:
        rows, partners = big.filter(whole & is_frequent), small.filter(is_frequent)
        if measured_bytes(partners) <= max_bytes:
            parts.append(rows.join(F.broadcast(partners), on, how))
        else:
            salted = partners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            parts.append(rows.join(salted, [*on, "_salt"], how))
    if nulls and how == "left":
        missing = [F.lit(None).cast(small.schema[c].dataType).alias(c) for c in small.columns if c not in on]
        parts.append(big.filter(~whole).select(*big.columns, *missing))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def join_bounded(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join (inner or left) ``big`` to ``small``: broadcast if ``small`` measures at most ``max_bytes``, else ``join_split``."""
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on=on, how=how)
    return join_split(big, small, on, how)


def _bit_places(on: Sequence[str], buckets: int) -> list[Column]:
    """[bucket, place, place, ...] of a key in the filter."""
    places = [F.pmod(F.xxhash64(*on, F.lit(i)), F.lit(BUCKET_BITS)).cast("int") for i in range(1, BITS_SET + 1)]
    return [F.pmod(F.xxhash64(*on, F.lit(0)), F.lit(buckets)).cast("int"), *places]


def bloom_filter(keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, int]:
    """(``_bucket``, ``_words``: 512 words of 64 bits; number of buckets): a Bloom filter of ``keys``' rows.

    Sized for their number, 16 MB at most.
    """
    buckets = min(MAX_BUCKETS, max(1, math.ceil(keys.count() * BITS_PER_KEY / BUCKET_BITS)))
    bucket, *places = _bit_places(on, buckets)
    bits = keys.select(bucket.alias("_bucket"), F.explode(F.array(*places)).alias("_place"))
    words = bits.groupBy("_bucket", F.floor(F.col("_place") / 64).cast("int").alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, _place % 64))").alias("_set")
    )
    by_word = words.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_by_word"))
    every = F.sequence(F.lit(0), F.lit(BUCKET_BITS // 64 - 1))
    filled = F.transform(every, lambda w: F.coalesce(F.try_element_at("_by_word", w), F.lit(0).cast("long")))
    return by_word.select("_bucket", filled.alias("_words")), buckets


def keep_possible_matches(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``: all that are, and about one in fifty of the others.

    Rows with a null in the key go. Nothing is shuffled but the filter.
    """
    filter_rows, buckets = bloom_filter(keys.select(*on).dropna(), on)
    bucket, *places = _bit_places(on, buckets)
    set_ = [
        F.getbit(F.element_at("_words", (F.floor(p / 64) + 1).cast("int")), p % 64) == 1 for p in places
    ]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    rows = df.filter(whole).withColumn("_bucket", bucket).join(F.broadcast(filter_rows), "_bucket")
    return rows.filter(reduce(lambda a, b: a & b, set_)).select(*df.columns)
