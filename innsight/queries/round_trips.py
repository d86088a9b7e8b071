"""Registered queries that go through the readers and sinks.

Each writes rows derived from the driver's tables with a sink, reads them back
with the reader under test, and returns what was read. The files live in the
session's shared folder and belong to the process's cuts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight import jobs
from innsight.fixed_values import DATE_PARTS, LABELS_COLUMN, SUMMARY_KEYS
from innsight.functions.columns import labels_text
from innsight.operators import properties, rates
from innsight.plans.lineage import current_cuts, cut_lineage, scratch_path
from innsight.queries import compset as compset_queries
from innsight.queries import rates as rate_queries
from innsight.sinks import read_partitioned, save_partitioned_table, write_partitioned, write_single_csv, write_sorted_csv
from innsight.sources import fixtures as fx
from innsight.sources.bookings import read_bookings_parquet, read_bookings_sql_file, read_bookings_table
from innsight.sources.search_log import read_rate_lookup, read_search_log, read_search_log_checked

CITY = "city_code"
DIGITS = 6


def _written_log(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "log")
    write_partitioned(fx.fixture_search_log(spark, sf_dir, None), path, DATE_PARTS)
    return path


def _written_lookup(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "lookup")
    fx.fixture_rate_lookup(spark, sf_dir).write.parquet(path)
    return path


def _rounded_bookings(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, DIGITS).alias(c) if c in ("yield", "adr") else F.col(c) for c in df.columns]
    )


def log_read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + F1: the log from its date folders, declared schema, folders pruned by the window."""
    log = read_search_log(spark, _written_log(spark, sf_dir)).filter(fx.FIXTURE_WINDOW.predicate())
    return log.select(
        *rate_queries.FLAT_LOG, "id", F.size(LABELS_COLUMN).alias("label_count"), labels_text(LABELS_COLUMN).alias("labels_text")
    )


def log_read_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``log_read_window``, with a file of another column type among the first day's; it is left out and counted."""
    path = _written_log(spark, sf_dir)
    first = read_search_log(spark, path).filter(fx.FIXTURE_WINDOW.predicate())
    numbered = first.withColumn("id", F.xxhash64("id")).coalesce(1)
    day = F.make_date("year", "month", "day") == F.lit(fx.FIXTURE_WINDOW.first)
    numbered.filter(day).write.mode("append").partitionBy(*DATE_PARTS).parquet(path)
    log, left_out = read_search_log_checked(spark, path)
    return log.filter(fx.FIXTURE_WINDOW.predicate()).select(
        *rate_queries.FLAT_LOG, "id", F.size(LABELS_COLUMN).alias("label_count"), labels_text(LABELS_COLUMN).alias("labels_text"),
        F.lit(left_out.count()).cast("long").alias("files_left_out"),
    )


def lookup_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup, schema from the files."""
    return read_rate_lookup(spark, _written_lookup(spark, sf_dir))


def rate_job_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + S3: the rate job's output by day, read back with typed partition columns."""
    out = scratch_path(spark, "rates")
    jobs.run_rate_frequency(
        spark, _written_log(spark, sf_dir), _written_lookup(spark, sf_dir), fx.FIXTURE_WINDOW, out,
        scratch_path(spark, "summary"),
    )
    return read_partitioned(spark, out)


def rate_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + K3 + O1: the summary of the written output, through one sorted CSV file; ``place`` is the line."""
    out, summary = scratch_path(spark, "rates"), scratch_path(spark, "summary")
    jobs.run_rate_frequency(
        spark, _written_log(spark, sf_dir), _written_lookup(spark, sf_dir), fx.FIXTURE_WINDOW, out, summary
    )
    schema = "year int, month int, day int, CWT_RATE_TYPE string, top3_rate_flag int, total_responses long"
    lines = spark.read.schema(schema).csv(summary, header=True)
    # one small file is one partition, whose rows come in the order of its lines
    return lines.select("*", F.monotonically_increasing_id().alias("place"))


def bookings_read_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings by a SQL text file over a catalog table, and K4: that table, partitioned by city."""
    table = f"innsight_bookings_{uuid.uuid4().hex}"
    save_partitioned_table(fx.fixture_bookings(spark, sf_dir), table, [CITY])
    current_cuts().add(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    sql_path = scratch_path(spark, "sql")
    text = f"SELECT * FROM {table} WHERE created_date >= DATE'{fx.FIXTURE_BOOKINGS_SINCE}'"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(sql_path)
    return _rounded_bookings(read_bookings_sql_file(spark, sql_path))


def bookings_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 + S4: bookings saved as a managed table by city, and read from the catalog."""
    table = f"innsight_bookings_{uuid.uuid4().hex}"
    save_partitioned_table(fx.fixture_bookings(spark, sf_dir), table, [CITY])
    current_cuts().add(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    return _rounded_bookings(read_bookings_table(spark, table))


def properties_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: property rows written in one folder per city and read with the written types."""
    path = scratch_path(spark, "cities")
    bookings = scratch_path(spark, "bookings")
    fx.fixture_bookings(spark, sf_dir).write.parquet(bookings)
    props = properties.property_metrics(read_bookings_parquet(spark, bookings))
    write_partitioned(props, path, [CITY])
    return compset_queries._property_view(read_partitioned(spark, path, props.schema))


def properties_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + O1: property names through sorted CSV files; ``files_in_order`` checks them against each other."""
    path = scratch_path(spark, "csv")
    order = [CITY, "harp_property_id_no", "hotel_name"]
    names = properties.current_property_names(fx.fixture_bookings(spark, sf_dir)).select(*order)
    write_sorted_csv(names, path, order, files=4)
    lines = spark.read.schema("city_code string, harp_property_id_no string, hotel_name string").csv(path, header=True)
    per_file = lines.groupBy(F.input_file_name().alias("file")).agg(
        F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")
    )
    # one row per file written
    files = [(r.first, r.last) for r in per_file.orderBy("file").collect()]
    in_order = all(a[1] <= b[0] for a, b in zip(files, files[1:]))
    return lines.select("*", F.lit(in_order).alias("files_in_order"), F.lit(len(files) > 1).alias("several_files"))


def lineage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the rate rows after a lineage cut, re-read and aggregated."""
    log = fx.fixture_search_log(spark, sf_dir, None)
    cut = cut_lineage(rates.distinct_rates(rates.attach_rate_bucket(rates.select_window(log, None), fx.fixture_rate_lookup(spark, sf_dir))))
    return cut.groupBy(*DATE_PARTS, "new_rate_bucket").agg(F.count(F.lit(1)).alias("n"))


def frequency_single_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a summary per bucket through one CSV file."""
    path = scratch_path(spark, "one")
    summary = rate_queries.rate_frequency(spark, sf_dir).groupBy("new_rate_bucket").agg(F.sum("responses").alias("n"))
    write_single_csv(summary, path, ["new_rate_bucket"])
    return spark.read.schema("new_rate_bucket string, n long").csv(path, header=True)


_LOG, _FLAT = rate_queries._LOG, rate_queries._FLAT
_BOOKINGS = """harp_property_id_no, hotel_name, hotel_chain_name, city_code, x, y, created_date, star_rating,
       round("yield", 6) "yield", round(adr, 6) adr"""
_SUMMARY_ORDER = ", ".join(f'"{c}" nulls first' for c in SUMMARY_KEYS)

ORACLE = {
    "log_read_window": f"""with {_LOG}
select {_FLAT}, id, label_count, labels_text from win""",
    "log_read_checked": f"""with {_LOG}
select {_FLAT}, id, label_count, labels_text, cast(1 as bigint) files_left_out from win""",
    "lookup_read": rate_queries.ORACLE["scan_rate_lookup"],
    "rate_job_output": rate_queries.ORACLE["rate_frequency"],
    "rate_job_summary": f"""with t as ({rate_queries.ORACLE["rate_summary"]})
select *, row_number() over (order by {_SUMMARY_ORDER}) - 1 place from t""",
    "bookings_read_sql": compset_queries.ORACLE["bookings_since"],
    "bookings_read_table": f"""with {compset_queries._CHAIN}
select {_BOOKINGS} from b""",
    "properties_by_city": compset_queries.ORACLE["property_metrics"],
    "properties_csv": f"""with {compset_queries._CHAIN}
select city_code, harp_property_id_no, hotel_name, true files_in_order, true several_files from cur""",
    "lineage_cut": f"""with {_LOG}
select "year", "month", "day", new_rate_bucket, count(*) n from uniq group by all""",
    "frequency_single_csv": f"""with f as ({rate_queries.ORACLE["rate_frequency"]})
select new_rate_bucket, cast(sum(responses) as bigint) n from f group by all""",
}
