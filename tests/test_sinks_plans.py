"""Sinks, read-back, the two jobs end to end, and physical-plan properties."""

from __future__ import annotations

import csv
import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from innsight import jobs
from innsight.operators import compset as cs
from innsight.operators import knn, properties, rates
from innsight.plans import lineage
from innsight.plans.inspect import plan_text
from innsight.sinks import (
    read_partitioned,
    save_partitioned_table,
    write_partitioned,
    write_single_csv,
    write_sorted_csv,
)
from innsight.sources import fixtures as fx
from innsight.sources.search_log import DATE_PARTS, SearchWindow, read_search_log

SF_SMALL = "/root/testdata/sf0.001"


def _write_fixture_log(spark, root):
    """The fixture search log as a real ``year=/month=/day=`` Parquet layout."""
    path = os.path.join(root, "log")
    fx.fixture_search_log(spark, SF_SMALL, window=None).write.partitionBy(*DATE_PARTS).parquet(path)
    lookup = os.path.join(root, "lookup")
    fx.fixture_rate_lookup(spark, SF_SMALL).write.parquet(lookup)
    return path, lookup


def test_partition_pruning_reaches_the_scan(spark, tmp_out):
    path, _ = _write_fixture_log(spark, tmp_out)
    log = read_search_log(spark, path)
    plan = plan_text(rates.select_window(log, fx.FIXTURE_WINDOW))
    assert "PartitionFilters" in plan and "isnotnull(year" in plan and "(day#" in plan
    assert "ReadSchema" in plan


def test_rate_job_end_to_end(spark, tmp_out):
    path, lookup = _write_fixture_log(spark, tmp_out)
    out = os.path.join(tmp_out, "rate_counts")
    jobs.run_rate_frequency(spark, path, lookup, fx.FIXTURE_WINDOW, out)
    written = read_partitioned(spark, out)
    expected = rates.rate_frequency(read_search_log(spark, path), fx.fixture_rate_lookup(spark, SF_SMALL),
                                    fx.FIXTURE_WINDOW)
    assert written.select(*expected.columns).exceptAll(expected).count() == 0
    assert written.count() == expected.count()
    days = sorted(os.path.basename(p) for p in glob.glob(os.path.join(out, "year=2024", "month=1", "day=*")))
    assert days == [f"day={d}" for d in range(24, 31)]
    files = glob.glob(os.path.join(out + "_summary", "*.csv"))
    assert len(files) == 1
    with open(files[0], newline="") as fh:
        rows = list(csv.DictReader(fh))
    keys = [(int(r["year"]), int(r["month"]), int(r["day"]), r["CWT_RATE_TYPE"], int(r["top3_rate_flag"])) for r in rows]
    assert keys == sorted(keys)
    assert sum(int(r["total_responses"]) for r in rows) == expected.agg(F.sum("responses")).first()[0]


def test_partition_column_keeps_string_type(spark, tmp_out):
    df = spark.createDataFrame([("001", 1), ("002", 2)], "city_code string, v int")
    out = os.path.join(tmp_out, "by_city")
    write_partitioned(df, out, ["city_code"])
    assert dict(read_partitioned(spark, out).dtypes)["city_code"] == "int"  # what discovery alone does
    typed = read_partitioned(spark, out, df.schema)
    assert dict(typed.dtypes)["city_code"] == "string"
    assert sorted(r["city_code"] for r in typed.collect()) == ["001", "002"]


def test_overwrite_replaces_earlier_partitions(spark, tmp_out):
    out = os.path.join(tmp_out, "cities")
    write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "city_code string, v int"), out, ["city_code"])
    write_partitioned(spark.createDataFrame([("b", 3)], "city_code string, v int"), out, ["city_code"])
    assert [r["v"] for r in spark.read.parquet(out).collect()] == [3]
    write_partitioned(spark.createDataFrame([("c", 4)], "city_code string, v int"), out, ["city_code"],
                      replace_partitions_only=True)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [3, 4]


def test_comp_set_job_end_to_end(spark, tmp_out):
    bookings = fx.fixture_bookings(spark, SF_SMALL)
    out, csv_out = os.path.join(tmp_out, "parquet"), os.path.join(tmp_out, "csv")
    table = "compset_test_table"
    jobs.run_comp_sets(spark, bookings, out, csv_out, table)
    written = read_partitioned(spark, out)
    assert written.columns[:26] == cs.REPORT_COLUMNS
    n = written.count()
    assert n > 0 and spark.table(table).count() == n
    rows = []
    for file in sorted(glob.glob(os.path.join(csv_out, "*.csv"))):
        with open(file, newline="") as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == n and "features" not in rows[0]
    cities = [r["city_code"] for r in rows]
    assert cities == sorted(cities)
    left_out = glob.glob(os.path.join(out + "_left_out", "*.csv"))
    assert len(left_out) == 1
    spark.sql(f"DROP TABLE {table}")


def test_save_partitioned_table(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "city_code string, v int")
    save_partitioned_table(df, "sink_test_table", ["city_code"])
    assert spark.table("sink_test_table").count() == 2
    parts = [r[0] for r in spark.sql("SHOW PARTITIONS sink_test_table").collect()]
    assert sorted(parts) == ["city_code=x", "city_code=y"]
    spark.sql("DROP TABLE sink_test_table")


def test_single_csv_keeps_order(spark, tmp_out):
    df = spark.range(0, 1000, 1, 8).select((F.col("id") * 7919 % 1000).alias("k"))
    out = os.path.join(tmp_out, "one")
    write_single_csv(df, out, order_by=["k"])
    files = glob.glob(os.path.join(out, "*.csv"))
    assert len(files) == 1
    with open(files[0]) as fh:
        ks = [int(line) for line in fh.read().split()[1:]]
    assert ks == sorted(ks) and len(ks) == 1000


def test_knn_plan_is_window_group_limit_without_python(spark):
    pts = cs.prepare_points(properties.property_metrics(fx.fixture_bookings(spark, SF_SMALL)))
    plan = plan_text(knn.knn_exact(pts, ["scaled_x", "scaled_y"], k=10))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_rate_frequency_plan_has_two_exchanges_and_no_python(spark):
    freq = rates.rate_frequency(fx.fixture_search_log(spark, SF_SMALL), fx.fixture_rate_lookup(spark, SF_SMALL),
                                fx.FIXTURE_WINDOW)
    plan = plan_text(freq, "simple")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "BroadcastHashJoin" in plan and "PythonUDF" not in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_bookings_are_folded_in_one_scan(spark):
    plan = plan_text(properties.fold_bookings(fx.fixture_bookings(spark, SF_SMALL)), "simple")
    assert plan.count("FileScan parquet") == 2  # orders and customer, once each
    after = plan_text(properties.property_metrics(fx.fixture_bookings(spark, SF_SMALL)), "simple")
    assert "orders" not in after  # the rest reads the written fold


def test_size_check_has_no_limit_over_one_partition(spark, monkeypatch):
    """The broadcast check is an aggregate: one row per task reaches the last one."""
    from innsight.plans import joins

    side = fx.fixture_rate_lookup(spark, SF_SMALL)
    rows = side.count()
    assert joins.measured_bytes(side) >= rows * (joins.ROW_BYTES + 2 * joins.FIELD_BYTES)
    assert joins.measured_bytes(side.limit(0)) == 0
    seen = []
    monkeypatch.setattr(joins, "measured_bytes", lambda df: seen.append(df) or 10)
    log = fx.fixture_search_log(spark, SF_SMALL)
    small = plan_text(rates.attach_rate_bucket(rates.select_window(log, None), side), "simple")
    assert "BroadcastHashJoin" in small and "GlobalLimit" not in small and "CollectLimit" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan_text(rates.attach_rate_bucket(rates.select_window(log, None), side, 9), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in large and len(seen) == 2


def test_bookings_from_table_and_sql_file(spark, tmp_out):
    from innsight.sources import read_bookings_sql_file, read_bookings_table

    fx.fixture_bookings(spark, SF_SMALL).createOrReplaceTempView("bookings_fixture")
    sql_path = os.path.join(tmp_out, "stage1.sql")
    with open(sql_path, "w") as fh:
        fh.write("SELECT * FROM bookings_fixture WHERE created_date >= DATE'1998-01-01'")
    from_sql = read_bookings_sql_file(spark, sql_path)
    expected = properties.bookings_since(read_bookings_table(spark, "bookings_fixture"), "1998-01-01")
    assert from_sql.exceptAll(expected).count() == 0 and expected.exceptAll(from_sql).count() == 0
    assert from_sql.count() > 0
    # the SQL source stays lazy: its filter reaches the Parquet scan
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan_text(from_sql)
    spark.catalog.dropTempView("bookings_fixture")


def test_job_command_line_parses():
    args = jobs._parser().parse_args(
        ["comp-sets", "--bookings-sql-file", "s.sql", "--since", "2018-05-01", "--output", "o", "--k", "5"]
    )
    assert (args.job, args.bookings_sql_file, args.since, args.k, args.method) == ("comp-sets", "s.sql", "2018-05-01", 5, "exact")


@pytest.mark.parametrize("end", ["--first-day", "--last-day"])
def test_half_a_window_is_an_error(end, tmp_out):
    out = os.path.join(tmp_out, "o")
    with pytest.raises(ValueError, match="first and its last day"):
        jobs.main(["rate-frequency", "--search-log", "l", "--lookup", "u", end, "2019-05-24", "--output", out])
    assert not os.path.exists(out)
    with pytest.raises(ValueError, match="before it begins"):
        SearchWindow.between("2019-05-24", "2019-05-23")
    assert SearchWindow.between(None, None) is None


def test_window_across_months(spark):
    window = SearchWindow.between("2023-11-28", "2024-02-03")
    days = spark.range(1000).select(F.date_add(F.lit("2022-06-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days = days.select("d", F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"))
    got = [r.d for r in days.filter(window.predicate()).orderBy("d").collect()]
    assert got[0] == datetime.date(2023, 11, 28) and got[-1] == datetime.date(2024, 2, 3) and len(got) == 68


def test_rate_job_from_the_command_line(spark, tmp_out):
    """main() end to end, twice: a run for one day with --replace-days leaves the other days."""
    path, lookup = _write_fixture_log(spark, tmp_out)
    out = os.path.join(tmp_out, "rates")
    common = ["rate-frequency", "--search-log", path, "--lookup", lookup, "--output", out]
    before = set(os.listdir(lineage.checkpoint_dir(spark))) if os.path.isdir(lineage.checkpoint_dir(spark)) else set()
    assert jobs.main([*common, "--first-day", "2024-01-24", "--last-day", "2024-01-30", "--checkpoint"]) == 0
    whole = read_partitioned(spark, out).count()
    assert jobs.main([*common, "--first-day", "2024-01-26", "--last-day", "2024-01-26", "--replace-days"]) == 0
    assert read_partitioned(spark, out).count() == whole
    assert jobs.main([*common, "--first-day", "2024-01-26", "--last-day", "2024-01-26"]) == 0
    assert {r.day for r in read_partitioned(spark, out).select("day").distinct().collect()} == {26}
    assert set(os.listdir(lineage.checkpoint_dir(spark))) <= before  # the cuts of the jobs are gone


def test_comp_set_job_from_the_command_line(spark, tmp_out):
    bookings, out = os.path.join(tmp_out, "bookings"), os.path.join(tmp_out, "sets")
    fx.fixture_bookings(spark, SF_SMALL).write.parquet(bookings)
    assert jobs.main(["comp-sets", "--bookings-parquet", bookings, "--output", out, "--k", "3"]) == 0
    sets = read_partitioned(spark, out).groupBy("city_code", "target_property_harp_ID").count()
    assert 0 < sets.agg(F.max("count")).first()[0] <= 3


def test_sorted_csv_has_several_writers(spark, tmp_out):
    out = os.path.join(tmp_out, "many")
    df = spark.range(0, 5000, 1, 8).select((F.col("id") * 7919 % 5000).alias("k"))
    write_sorted_csv(df, out, ["k"], files=6)
    files = sorted(glob.glob(os.path.join(out, "*.csv")))
    assert len(files) > 1
    ks = []
    for file in files:
        with open(file) as fh:
            ks += [int(line) for line in fh.read().split()[1:]]
    assert ks == list(range(5000))


def test_lineage_cut_is_written_and_released(spark):
    df = spark.range(100).withColumn("sq", F.col("id") * F.col("id"))
    with lineage.job_cuts() as cuts:
        cut = lineage.cut_lineage(df, label="test")
        (path,) = cuts.paths
        assert path.startswith(lineage.checkpoint_dir(spark))
        assert "FileScan parquet" in plan_text(cut, "simple")  # re-read from the files, not recomputed
        assert cut.agg(F.sum("sq")).first()[0] == sum(i * i for i in range(100))
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_failing_job_leaves_no_folder_and_no_other_jobs_cuts(spark):
    with lineage.job_cuts() as outer:
        kept = lineage.cut_lineage(spark.range(5), label="outer")
        with pytest.raises(RuntimeError), lineage.job_cuts() as inner:
            lineage.cut_lineage(spark.range(5), label="inner")
            (gone,) = inner.paths
            raise RuntimeError("the job fails")
        assert not os.path.exists(gone.removeprefix("file:"))
        assert kept.count() == 5 and len(outer.paths) == 1


def test_without_a_shared_folder_a_cut_is_persisted(spark, monkeypatch):
    monkeypatch.setattr(lineage, "checkpoint_dir", lambda spark: None)
    with lineage.job_cuts():
        cut = lineage.cut_lineage(spark.range(10).withColumn("r", F.rand()))
        assert cut.storageLevel.useDisk and cut.collect() == cut.collect()
    assert not cut.storageLevel.useDisk


def test_comp_set_attributes_join_without_python_or_cross(spark):
    points = lineage.cut_lineage(cs.prepare_points(properties.property_metrics(fx.fixture_bookings(spark, SF_SMALL))))
    plan = plan_text(cs.report_columns(cs.comp_set_metrics(cs.comp_set(points))), "simple")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
