"""Joins with frequent, null and outdated keys: equal to the plain join, evenly dealt."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from innsight.fixed_values import LOCATION_KEYS
from innsight.operators import properties, rates
from innsight.plans import joins


def _rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture()
def no_merging(spark):
    """Partitions as the shuffle deals them, and joins as the planner first has them."""
    changed = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _skewed(spark, n=40_000):
    """Half the ids null, a third of the others one id, the rest even."""
    spread = F.pmod(F.xxhash64("id"), F.lit(5_000))
    key = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(spread)
    return spark.range(0, n, 1, 16).select(F.col("id").alias("row"), key.cast("string").alias("k"), F.lit("x").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_the_plain_join(spark, no_merging, how):
    big = _skewed(spark, 5_000)
    small = spark.createDataFrame(
        [(str(i), f"b{i % 7}") for i in range(-1, 3_000)] + [("-1", "again"), (None, "null")], "k string, bucket string"
    )
    assert joins.frequent_keys(big, ["k"])[1] == 2_500
    want = _rows(big.join(small, "k", how))
    assert _rows(joins.join_split(big, small, ["k"], how)) == want
    # frequent rows of the small side too many to broadcast: salted
    assert _rows(joins.join_split(big, small, ["k"], how, max_bytes=0)) == want


def test_split_join_without_rows_nulls_or_frequent_keys(spark):
    small = spark.createDataFrame([("a", 1)], "k string, n int")
    empty = spark.createDataFrame([], "k string, v int")
    even = spark.createDataFrame([(str(i), i) for i in range(100)], "k string, v int")
    assert joins.join_split(empty, small, ["k"], "left").count() == 0
    assert _rows(joins.join_split(even, small, ["k"], "left")) == _rows(even.join(small, "k", "left"))
    with pytest.raises(ValueError):
        joins.join_split(even, small, ["k"], "full")


def test_null_and_frequent_ids_meet_in_no_task(spark, no_merging):
    """Broadcast off, half the ids null, a sixth one id: the largest task is within 3x the median."""
    big = _skewed(spark).withColumnRenamed("k", "rate_id")
    lookup = spark.range(-1, 5_000).select(F.col("id").cast("string").alias("rate_id"), F.lit("B").alias("new_rate_bucket"))
    got = rates.attach_rate_bucket(big, lookup, max_broadcast_bytes=0)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == 40_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    plain = big.join(lookup, "rate_id", "left")
    plain_sizes = sorted(r["count"] for r in plain.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert plain_sizes[-1] > 3 * plain_sizes[len(plain_sizes) // 2]
    want = plain.withColumn("new_rate_bucket", F.coalesce("new_rate_bucket", F.lit("OTHER")))
    assert _rows(got) == _rows(want)


def _bookings(spark, properties_=60, moves=20, per_location=5, hot=2_000):
    """Each property moved ``moves`` times, so most bookings are of outdated locations; one hotel is hot."""
    rows = []
    for p in range(properties_):
        for m in range(moves):
            for b in range(per_location):
                chain = None if p == 3 and b == 0 else "chain"
                rows.append((f"p{p}", f"n{m % 3}", chain, "c", float(m), float(p), dt.date(2019, 1, 1) + dt.timedelta(m), "3-STAR", 1.0 * b, 2.0))
    rows += [("hot", "h", "chain", "c", 0.5, 0.5, dt.date(2019, 1, 1), "4-STAR", 1.0, float(i)) for i in range(hot)]
    schema = (
        "harp_property_id_no string, hotel_name string, hotel_chain_name string, city_code string, "
        "x double, y double, created_date date, star_rating string, yield double, adr double"
    )
    return spark.createDataFrame(rows, schema)


def test_current_names_by_filter_and_split_equal_the_broadcast(spark, no_merging):
    bookings = _bookings(spark)
    want = _rows(properties.bookings_with_current_names(bookings))
    assert _rows(properties.bookings_with_current_names(bookings, max_broadcast_bytes=0)) == want


def test_outdated_bookings_are_dropped_before_the_shuffle(spark):
    bookings = _bookings(spark, hot=0)
    names = properties.current_property_names(bookings).cache()
    current = bookings.join(names.select(*LOCATION_KEYS), LOCATION_KEYS, "left_semi").count()
    kept = joins.keep_possible_matches(bookings, names, LOCATION_KEYS)
    assert kept.columns == bookings.columns
    assert kept.join(names.select(*LOCATION_KEYS), LOCATION_KEYS, "left_semi").count() == current
    assert current <= kept.count() <= current + 0.05 * bookings.count() < 0.2 * bookings.count()
    names.unpersist()


def test_filter_lets_few_others_pass_and_is_bounded(spark, monkeypatch):
    keys = spark.range(20_000).select((F.col("id") * 2).alias("k"))
    others = spark.range(20_000).select((F.col("id") * 2 + 1).alias("k"))
    assert joins.keep_possible_matches(keys, keys, ["k"]).count() == 20_000
    assert joins.keep_possible_matches(others, keys, ["k"]).count() < 0.05 * 20_000
    monkeypatch.setattr(joins, "MAX_BUCKETS", 1)  # far too small: no key is lost
    rows, buckets = joins.bloom_filter(keys, ["k"])
    assert buckets == 1 and rows.count() == 1
    assert joins.keep_possible_matches(keys, keys, ["k"]).count() == 20_000
