"""Safe overwrite, recovery of an interrupted publication, and the summary kept by day."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from innsight import jobs
from innsight.operators.rates import rate_summary
from innsight.sinks import daily_summary, publish
from innsight.sinks.writers import read_partitioned, write_partitioned, write_single_csv

SCHEMA = "year int, month int, day int, v int"
KEYS = ["year", "month", "day"]


def _days(spark, *days, v=1):
    return spark.createDataFrame([(2019, 5, d, v) for d in days], SCHEMA)


def _read(spark, path):
    return sorted((r["day"], r["v"]) for r in read_partitioned(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())


def _failing(df):
    """Fails while its rows are written, after some files are there."""
    return df.withColumn("v", F.when(F.col("day") > 0, F.raise_error(F.lit("broken"))).cast("int"))


@pytest.mark.parametrize("partitions_only", [False, True])
def test_failed_write_leaves_the_old_output(spark, tmp_out, partitions_only):
    out = f"{tmp_out}/out"
    write_partitioned(_days(spark, 1, 2), out, KEYS)
    with pytest.raises(Exception, match="broken"):
        write_partitioned(_failing(_days(spark, 2, 3)), out, KEYS, replace_partitions_only=partitions_only)
    assert _read(spark, out) == [(1, 1), (2, 1)]
    assert os.listdir(tmp_out) == ["out"]  # nothing left beside it


def test_failed_csv_leaves_the_old_one(spark, tmp_out):
    out = f"{tmp_out}/summary"
    write_single_csv(_days(spark, 1), out)
    with pytest.raises(Exception, match="broken"):
        write_single_csv(_failing(_days(spark, 2)), out)
    assert spark.read.csv(out, header=True).count() == 1


def test_whole_and_partial_overwrite(spark, tmp_out):
    out = f"{tmp_out}/out"
    assert write_partitioned(_days(spark, 1, 2), out, KEYS) is None
    made = write_partitioned(_days(spark, 2, 3, v=5), out, KEYS, replace_partitions_only=True)
    assert made == ["year=2019/month=5/day=2", "year=2019/month=5/day=3"]
    assert _read(spark, out) == [(1, 1), (2, 5), (3, 5)]
    write_partitioned(_days(spark, 4), out, KEYS)
    assert _read(spark, out) == [(4, 1)]
    write_partitioned(_days(spark, 5), out, KEYS, mode="append")
    assert _read(spark, out) == [(4, 1), (5, 1)]


@pytest.mark.parametrize("partitions_only", [False, True])
@pytest.mark.parametrize("moves", [0, 1, 2, 3])
def test_interrupted_publication_is_carried_on(spark, tmp_out, monkeypatch, partitions_only, moves):
    """However many renames were done when the driver died, the next step finishes the same publication."""
    out = f"{tmp_out}/out"
    write_partitioned(_days(spark, 1, 2, 3), out, KEYS)
    done, move = [], publish.Folder.move

    def stopping(self, *args):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(move(self, *args))

    monkeypatch.setattr(publish.Folder, "move", stopping)
    with pytest.raises(KeyboardInterrupt) if moves < (4 if partitions_only else 2) else _nothing():
        write_partitioned(_days(spark, 2, 3, v=7), out, KEYS, replace_partitions_only=partitions_only)
    monkeypatch.setattr(publish.Folder, "move", move)
    publish.recover(spark, out)
    spark.catalog.refreshByPath(out)
    assert _read(spark, out) == ([(1, 1)] if partitions_only else []) + [(2, 7), (3, 7)]
    assert os.listdir(tmp_out) == ["out"]
    assert publish.recover(spark, out) is False


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def _summary(spark, path):
    return sorted((tuple(r) for r in spark.read.csv(path, header=True).collect()), key=str)


def test_rerun_of_one_day_reads_one_day(spark, tmp_out, monkeypatch):
    from innsight.sources import fixtures as fx
    from innsight.sources.search_log import SearchWindow

    log = fx.fixture_search_log(spark, "/root/testdata/sf0.001", None)
    days = [tuple(r) for r in log.select(*KEYS).distinct().orderBy(*KEYS).limit(4).collect()]
    assert len(days) == 4
    keep = log.filter(F.struct(*KEYS).isin([F.struct(*map(F.lit, d)) for d in days]))
    write_partitioned(keep, f"{tmp_out}/log", KEYS)
    spark.createDataFrame([("1", "BAR")], "rate_id string, new_rate_bucket string").write.parquet(f"{tmp_out}/lookup")
    out = f"{tmp_out}/out"
    read = []

    def watched(rows):
        if rows.inputFiles() and "/out/" in rows.inputFiles()[0]:
            files = rows.select(F.input_file_name().alias("f")).distinct().collect()
            read.append({r["f"].split("/out/")[1].rsplit("/", 1)[0] for r in files})
        return rate_summary(rows)

    monkeypatch.setattr(jobs, "rate_summary", watched)
    jobs.run_rate_frequency(spark, f"{tmp_out}/log", f"{tmp_out}/lookup", None, out)
    assert len(read[0]) == 4
    first = _summary(spark, out + "_summary")
    assert first
    del read[0]
    iso = "-".join(f"{p:02d}" for p in days[1])
    jobs.run_rate_frequency(
        spark, f"{tmp_out}/log", f"{tmp_out}/lookup", SearchWindow.between(iso, iso), out, replace_days=True
    )
    assert read == [{"year={}/month={}/day={}".format(*days[1])}]
    # the same log, so the summary equals that of the whole run
    assert _summary(spark, out + "_summary") == first
    whole = rate_summary(read_partitioned(spark, out))
    assert sorted((tuple(r) for r in whole.select([F.col(c).cast("string") for c in whole.columns]).collect()), key=str) == first


def test_parts_follow_the_output(spark, tmp_out):
    out, schema = f"{tmp_out}/out", spark.createDataFrame([], SCHEMA).schema
    total = lambda df: df.groupBy(*KEYS).agg(F.sum("v").alias("total"))
    refresh = lambda: daily_summary.refresh_parts(spark, out, schema, KEYS, total)
    result = lambda: sorted((r["day"], r["total"]) for r in daily_summary.read_summary(spark, out, total(_days(spark, 1)).schema).collect())
    write_partitioned(_days(spark, 1, 2, 3), out, KEYS)
    assert len(refresh()) == 3 and refresh() == []
    write_partitioned(_days(spark, 3, 3, v=4), out, KEYS, replace_partitions_only=True)
    assert refresh() == ["year=2019/month=5/day=3"]
    assert result() == [(1, 1), (2, 1), (3, 8)]
    # a part that was lost is made again once the manifest is gone with it; days that are gone go
    write_partitioned(_days(spark, 2), out, KEYS)
    assert refresh() == ["year=2019/month=5/day=2"]
    assert result() == [(2, 1)]
    publish.Folder(spark, daily_summary.parts_path(out)).delete()
    assert refresh() == ["year=2019/month=5/day=2"] and result() == [(2, 1)]
    write_partitioned(_days(spark, 1).filter("false"), out, KEYS)
    assert refresh() == [] and result() == []
