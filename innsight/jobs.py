"""The two batch jobs end to end, and a command line for ``spark-submit``.

    spark-submit --py-files innsight.zip innsight/jobs.py rate-frequency \\
        --search-log P --lookup P --first-day 2019-05-24 --last-day 2019-05-30 --output P
    spark-submit --py-files innsight.zip --files stage1.sql innsight/jobs.py comp-sets \\
        --bookings-sql-file stage1.sql --output P [--csv P] [--table db.name] [--k 10]

Deployment settings (executors, memory, shuffle partitions, checkpoint folder)
are ``spark-submit --conf`` options, not code. Each job writes with a single
action per output and reads its own output back for the summaries, so a
summary never recomputes the analysis; the rate summary is kept by day and reads
only the days that have changed. A run replaces its whole output, unless
``--replace-days`` (rate frequency) limits that to the days it has rows for.
What a job writes on the side goes when it ends, also when it fails.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.fixed_values import DATE_PARTS, SUMMARY_KEYS
from innsight.operators.compset import comp_set_report_of_points, prepare_points
from innsight.operators.features import left_out_rows
from innsight.operators.geo import geo_clean
from innsight.operators.knn import NEIGHBOUR_ID, TARGET_ID
from innsight.operators.properties import bookings_since, property_metrics
from innsight.operators.rates import rate_frequency, rate_summary
from innsight.plans.lineage import cut_lineage, job_cuts
from innsight.sinks.daily_summary import read_summary, refresh_parts
from innsight.sinks.writers import read_partitioned, save_partitioned_table, write_partitioned, write_single_csv, write_sorted_csv
from innsight.sources.bookings import (
    read_bookings_parquet,
    read_bookings_sql_file,
    read_bookings_table,
)
from innsight.sources.search_log import SearchWindow, read_rate_lookup, read_search_log

CITY = "city_code"
VECTOR_COLUMNS = ["features", "scaledFeatures"]


def run_rate_frequency(
    spark: SparkSession,
    search_log_path: str,
    lookup_path: str,
    window: SearchWindow | None,
    output_path: str,
    summary_path: str | None = None,
    checkpoint: bool = False,
    replace_days: bool = False,
) -> None:
    """Rate counts per search (Parquet by day) and a one-file CSV summary of the whole output.

    The summary is kept by day beside the output: only days whose files have
    changed since the last run are read for it.
    """
    frequency = rate_frequency(
        read_search_log(spark, search_log_path), read_rate_lookup(spark, lookup_path), window, checkpoint=checkpoint
    )
    write_partitioned(frequency, output_path, DATE_PARTS, replace_partitions_only=replace_days)
    refresh_parts(spark, output_path, frequency.schema, DATE_PARTS, rate_summary)
    summary = read_summary(spark, output_path, rate_summary(frequency).schema)
    write_single_csv(summary, summary_path or output_path.rstrip("/") + "_summary", SUMMARY_KEYS)


def run_comp_sets(
    spark: SparkSession,
    bookings: DataFrame,
    output_path: str,
    csv_path: str | None = None,
    table: str | None = None,
    k: int = 10,
    method: str = "exact",
    vectors: bool = False,
) -> None:
    """Competitive sets of every city (Parquet by city), optionally a CSV dump and a table.

    Beside the output, ``<output>_left_out`` counts per city the property rows
    that lack a feature and so have no set.
    """
    # the fold of the bookings feeds both the count and the report
    props = cut_lineage(property_metrics(bookings), label="properties")
    points = cut_lineage(prepare_points(props), label="points")
    report = comp_set_report_of_points(points, k=k, method=method, vectors=vectors)
    write_partitioned(report, output_path, [CITY])
    left_out = left_out_rows(geo_clean(props.filter(F.col(CITY).isNotNull())))
    write_single_csv(left_out, output_path.rstrip("/") + "_left_out", [CITY])
    written = read_partitioned(spark, output_path, report.schema)
    if csv_path:
        write_sorted_csv(written, csv_path, order_by=[CITY, TARGET_ID, "knn_distance_metric", NEIGHBOUR_ID],
                         drop=VECTOR_COLUMNS)
    if table:
        save_partitioned_table(written, table, [CITY])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="innsight.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    r = sub.add_parser("rate-frequency", help="rate frequency per search, plus summary CSV")
    r.add_argument("--search-log", required=True)
    r.add_argument("--lookup", required=True)
    r.add_argument("--first-day", help="yyyy-MM-dd; with --last-day, else the whole log")
    r.add_argument("--last-day", help="yyyy-MM-dd, inclusive")
    r.add_argument("--output", required=True)
    r.add_argument("--summary-output")
    r.add_argument("--replace-days", action="store_true", help="replace only the days this run has rows for")
    r.add_argument("--checkpoint", action="store_true", help="cut lineage after de-duplication")
    c = sub.add_parser("comp-sets", help="competitive sets per city")
    src = c.add_mutually_exclusive_group(required=True)
    src.add_argument("--bookings-parquet")
    src.add_argument("--bookings-table")
    src.add_argument("--bookings-sql-file")
    c.add_argument("--since", help="keep bookings created on or after this date (yyyy-MM-dd)")
    c.add_argument("--output", required=True)
    c.add_argument("--csv")
    c.add_argument("--table")
    c.add_argument("--k", type=int, default=10)
    c.add_argument("--method", choices=["exact", "lsh"], default="exact")
    c.add_argument("--vectors", action="store_true", help="write features as ML vectors, not arrays")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    # a window with one end only is an error, before anything runs
    window = SearchWindow.between(args.first_day, args.last_day) if args.job == "rate-frequency" else None
    # string columns written as plain BINARY by some producers read as strings
    spark = (
        SparkSession.builder.appName(f"innsight-{args.job}")
        .config("spark.sql.parquet.binaryAsString", "true")
        .getOrCreate()
    )
    with job_cuts():
        if args.job == "rate-frequency":
            run_rate_frequency(spark, args.search_log, args.lookup, window, args.output, args.summary_output,
                               args.checkpoint, args.replace_days)
        else:
            if args.bookings_parquet:
                bookings = read_bookings_parquet(spark, args.bookings_parquet)
            elif args.bookings_table:
                bookings = read_bookings_table(spark, args.bookings_table)
            else:
                bookings = read_bookings_sql_file(spark, args.bookings_sql_file)
            if args.since:
                bookings = bookings_since(bookings, args.since)
            run_comp_sets(spark, bookings, args.output, args.csv, args.table, args.k, args.method, args.vectors)
    return 0


if __name__ == "__main__":
    code = main()
    SparkSession.getActiveSession().stop()
    sys.exit(code)
