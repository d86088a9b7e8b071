"""Registered rate-frequency queries over the driver's tables (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions import columns as cols
from innsight.functions.columns import labels_text
from innsight.operators import labels as lab
from innsight.operators import rates
from innsight.sources import fixtures as fx
from innsight.sources.search_log import LABELS_COLUMN, SEARCH_LOG_SCHEMA

FLAT_LOG = ["year", "month", "day", "res_sessionID", "hotel_id"]


def _log(spark: SparkSession, sf_dir: str, windowed: bool = True) -> DataFrame:
    return fx.fixture_search_log(spark, sf_dir, fx.FIXTURE_WINDOW if windowed else None)


def scan_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in the declared schema (labels shown as count and text)."""
    log = _log(spark, sf_dir, windowed=False).select(*SEARCH_LOG_SCHEMA.fieldNames())
    return log.select(
        *FLAT_LOG,
        "id",
        F.size(LABELS_COLUMN).alias("label_count"),
        labels_text(LABELS_COLUMN).alias("labels_text"),
    )


def scan_rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate lookup."""
    return fx.fixture_rate_lookup(spark, sf_dir)


def search_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log rows of the window; on events the range of days is pushed into the scan."""
    return _log(spark, sf_dir).select(*FLAT_LOG, "id")


def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, needed columns, ``id`` renamed ``rate_id``."""
    rows = rates.select_window(_log(spark, sf_dir, windowed=False), None)
    return rows.select(*FLAT_LOG, "rate_id", F.size(LABELS_COLUMN).alias("label_count"))


def rate_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + X1: left join to the lookup, unmatched rates bucketed OTHER."""
    rows = rates.select_window(_log(spark, sf_dir, windowed=False), None)
    joined = rates.attach_rate_bucket(rows, fx.fixture_rate_lookup(spark, sf_dir))
    return joined.select(*FLAT_LOG, "rate_id", "new_rate_bucket")


def distinct_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: distinct (date, session, hotel, rate, bucket, labels)."""
    rows = rates.select_window(_log(spark, sf_dir, windowed=False), None)
    unique = rates.distinct_rates(rates.attach_rate_bucket(rows, fx.fixture_rate_lookup(spark, sf_dir)))
    return unique.select(*FLAT_LOG, "rate_id", "new_rate_bucket", labels_text(LABELS_COLUMN).alias("labels_text"))


def qualifying_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rates with at least one qualifying label, and how many they have."""
    rows = lab.keep_rates_with_qualifying_labels(rates.select_window(_log(spark, sf_dir, windowed=False), None))
    return rows.select(*FLAT_LOG, "rate_id", F.size(cols.qualifying_labels(LABELS_COLUMN)).alias("qualifying_count"))


def label_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per qualifying label."""
    rows = lab.explode_labels(rates.select_window(_log(spark, sf_dir, windowed=False), None))
    return rows.select(*FLAT_LOG, "rate_id", "label_id", "label_value")


def label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: explode + pivot back to rate type and rank columns, per distinct rate row."""
    rows = rates.select_window(_log(spark, sf_dir, windowed=False), None)
    unique = rates.distinct_rates(rates.attach_rate_bucket(rows, fx.fixture_rate_lookup(spark, sf_dir)))
    pivoted = lab.pivot_labels(lab.explode_labels(unique), rates.RATE_ROW_KEYS)
    return pivoted.select(
        *FLAT_LOG, "rate_id", "new_rate_bucket", labels_text(LABELS_COLUMN).alias("labels_text"),
        "CWT_RATE_TYPE", "CWT_RATE_SORTED_RANK",
    )


def top3_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate type, rank text and top-3 flag per rate row (array form)."""
    rows = rates.select_window(_log(spark, sf_dir, windowed=False), None)
    flagged = lab.with_top3_flag(lab.with_label_columns(rows))
    return flagged.select(*FLAT_LOG, "rate_id", "CWT_RATE_TYPE", "CWT_RATE_SORTED_RANK", "top3_rate_flag")


def rate_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 (flagship): responses per date, session, hotel, bucket, rate type and top-3 flag."""
    return rates.rate_frequency(_log(spark, sf_dir), fx.fixture_rate_lookup(spark, sf_dir), fx.FIXTURE_WINDOW)


def rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total responses per date, rate type and top-3 flag."""
    return rates.rate_summary(rate_frequency(spark, sf_dir))


# --- DuckDB oracles ----------------------------------------------------------
# The fixture log derived independently in SQL: ``kind`` names the label shape
# (N: one all-null label, M: type label with a mismatched type, E: empty array,
# L: rank and type labels, NULL: no array).
_LOG = """
e as (select *, try_cast(regexp_extract(props, '([0-9]+)', 1) as integer) k from events),
log as (
  select cast(year(ts) as integer) "year", cast(month(ts) as integer) "month",
         cast(day(ts) as integer) "day", cast(user_id as varchar) "res_sessionID",
         cast(event_id % 40 as varchar) hotel_id,
         case when k is not null then cast(event_id // 4 as varchar) end id,
         case when k is null then null when k % 10 = 0 then 'N' when k % 10 = 1 then 'M'
              when k % 10 = 2 then 'E' else 'L' end kind,
         event_type, cast(k % 7 as varchar) rk
  from e),
txt as (
  select *,
         case kind when 'N' then '~:~:~'
                   when 'M' then 'CWT_RATE_TYPE:OTHER:' || coalesce(event_type, '~')
                   when 'E' then ''
                   when 'L' then 'CWT_RATE_SORTED_RANK:CWT_RATE_SORTED_RANK:' || rk
                                 || '|CWT_RATE_TYPE:CWT_RATE_TYPE:' || coalesce(event_type, '~')
         end labels_text,
         case kind when 'N' then 1 when 'M' then 1 when 'E' then 0 when 'L' then 2 end label_count
  from log),
win as (select * from txt where "year" = 2024 and "month" = 1 and "day" between 24 and 30),
lk as (select cast(p_partkey as varchar) rate_id, p_type new_rate_bucket from part),
bucketed as (
  select t.*, t.id rate_id, coalesce(lk.new_rate_bucket, 'OTHER') new_rate_bucket
  from txt t left join lk on t.id = lk.rate_id),
uniq as (
  select distinct "year", "month", "day", "res_sessionID", hotel_id, rate_id, new_rate_bucket,
         labels_text, kind, event_type, rk
  from bucketed)
"""

_FLAT = '"year", "month", "day", "res_sessionID", hotel_id'

ORACLE = {
    "scan_search_log": f"""with {_LOG}
select {_FLAT}, id, label_count, labels_text from txt""",
    "scan_rate_lookup": f"""with {_LOG}
select rate_id, new_rate_bucket from lk""",
    "search_window_filter": f"""with {_LOG}
select {_FLAT}, id from win""",
    "search_projection": f"""with {_LOG}
select {_FLAT}, id rate_id, label_count from txt""",
    "rate_bucket_join": f"""with {_LOG}
select {_FLAT}, rate_id, new_rate_bucket from bucketed""",
    "distinct_rates": f"""with {_LOG}
select {_FLAT}, rate_id, new_rate_bucket, labels_text from uniq""",
    "qualifying_labels": f"""with {_LOG}
select {_FLAT}, id rate_id, case kind when 'N' then 1 else 2 end qualifying_count
from txt where kind in ('N', 'L')""",
    "label_explode": f"""with {_LOG}
select {_FLAT}, id rate_id, cast(null as varchar) label_id, cast(null as varchar) label_value
from txt where kind = 'N'
union all
select {_FLAT}, id rate_id, 'CWT_RATE_SORTED_RANK', rk from txt where kind = 'L'
union all
select {_FLAT}, id rate_id, 'CWT_RATE_TYPE', event_type from txt where kind = 'L'""",
    "label_pivot": f"""with {_LOG}
select {_FLAT}, rate_id, new_rate_bucket, labels_text,
       case when kind = 'L' then event_type end "CWT_RATE_TYPE",
       case when kind = 'L' then rk end "CWT_RATE_SORTED_RANK"
from uniq where kind in ('N', 'L')""",
    "top3_flag": f"""with {_LOG}
select {_FLAT}, id rate_id,
       case when kind = 'L' then event_type end "CWT_RATE_TYPE",
       case when kind = 'L' then rk end "CWT_RATE_SORTED_RANK",
       cast(case when kind = 'L' and try_cast(rk as float) between 1 and 3 then 1 else 0 end as integer)
         top3_rate_flag
from txt where kind in ('N', 'L')""",
    "rate_frequency": f"""with {_LOG}
select {_FLAT}, new_rate_bucket, case when kind = 'L' then event_type end "CWT_RATE_TYPE",
       cast(case when kind = 'L' and try_cast(rk as float) between 1 and 3 then 1 else 0 end as integer)
         top3_rate_flag,
       count(*) responses
from uniq where kind in ('N', 'L') and "year" = 2024 and "month" = 1 and "day" between 24 and 30
group by all""",
}
ORACLE["rate_summary"] = f"""with f as ({ORACLE['rate_frequency']})
select "year", "month", "day", "CWT_RATE_TYPE", top3_rate_flag, cast(sum(responses) as bigint) total_responses
from f group by all"""
