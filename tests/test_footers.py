"""Files that the declared schema does not fit: found by their footers, counted, the others read whole."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T

from innsight.plans.inspect import plan_text
from innsight.sources.footers import misfit, read_fitting
from innsight.sources.search_log import SEARCH_LOG_SCHEMA, SearchWindow, read_search_log, read_search_log_checked

LABELS = pa.list_(pa.struct([("id", pa.string()), ("type", pa.string()), ("value", pa.string())]))
LOG = {"res_sessionID": pa.string(), "hotel_id": pa.string(), "id": pa.string(), "ratePlan_tpaExtensions_labels_label": LABELS}


def put(root, day, name, n=2, **changed):
    kinds = {k: v for k, v in {**LOG, **changed}.items() if v is not None}
    values = {k: [None] * n if v == LABELS or pa.types.is_nested(v) else [7] * n if pa.types.is_integer(v) else [f"{name}"] * n
              for k, v in kinds.items()}
    folder = os.path.join(root, "year=2024", "month=1", f"day={day}")
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({k: pa.array(values[k], v) for k, v in kinds.items()}), os.path.join(folder, f"{name}.parquet"))
    return folder


def test_mixed_type_days_are_read_and_counted(spark, tmp_out):
    put(tmp_out, 1, "a")
    put(tmp_out, 1, "b odd%name")
    put(tmp_out, 2, "a")
    put(tmp_out, 2, "typed", hotel_id=pa.int64())
    put(tmp_out, 2, "lacks", id=None)
    put(tmp_out, 2, "more", extra=pa.int64())
    put(tmp_out, 3, "labels", ratePlan_tpaExtensions_labels_label=pa.list_(pa.struct([("id", pa.int64())])))
    folder = put(tmp_out, 4, "a", n=0)
    with open(os.path.join(folder, "broken.parquet"), "wb") as f:
        f.write(b"no parquet")
    open(os.path.join(folder, "_SUCCESS"), "w").close()
    rows, left_out = read_search_log_checked(spark, tmp_out)
    assert rows.columns == read_search_log(spark, tmp_out).columns
    got = sorted((r.day, r.res_sessionID, r.id is None) for r in rows.collect())
    assert got == sorted(2 * [(1, "a", False), (1, "b odd%name", False), (2, "a", False), (2, "lacks", True), (2, "more", False)])
    reasons = {os.path.basename(r.file): r.reason for r in left_out.collect()}
    assert sorted(reasons) == ["broken.parquet", "labels.parquet", "typed.parquet"]
    assert reasons["typed.parquet"] == "hotel_id: int64 instead of string" and "footer" in reasons["broken.parquet"]


def test_without_misfits_the_plan_is_the_ordinary_scan(spark, tmp_out):
    for day in (1, 2):
        put(tmp_out, day, "a")
    rows, left_out = read_search_log_checked(spark, tmp_out)
    assert left_out.isEmpty() and rows.count() == 4
    window = SearchWindow.between("2024-01-02", "2024-01-02").predicate()
    assert "PartitionFilters: [" in plan_text(rows.filter(window)) and rows.filter(window).count() == 2


def test_only_misfits_and_an_empty_folder(spark, tmp_out):
    put(tmp_out, 1, "typed", id=pa.int64())
    rows, left_out = read_search_log_checked(spark, tmp_out)
    assert rows.count() == 0 and left_out.count() == 1 and rows.schema == SEARCH_LOG_SCHEMA
    empty = os.path.join(tmp_out, "none")
    os.makedirs(empty)
    rows, left_out = read_fitting(spark, empty, SEARCH_LOG_SCHEMA)
    assert rows.count() == 0 and left_out.count() == 0


def test_misfit_rules():
    wanted = [T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DoubleType())]
    fits = lambda *columns: misfit([pa.field(*c) for c in columns], wanted) is None
    assert fits() and fits(("A", pa.binary())) and fits(("n", pa.int16()), ("d", pa.float32()), ("x", pa.date32()))
    assert not fits(("a", pa.int32())) and not fits(("n", pa.int64())) and not fits(("d", pa.string()))
    assert not fits(("a", pa.string()), ("A", pa.string()))
