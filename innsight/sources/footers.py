"""Parquet files whose columns do not fit the declared schema, found before they are read.

With a declared schema one file of another column type fails the whole scan.
Here every file's footer is compared with the schema first, in Spark tasks; the
files that fit are read, the others are returned with the reason, so that they
can be counted, kept and mended. Only footers are read for it, never the rows.

Defined cases: a column that a file lacks is null there, as in an ordinary scan;
names are compared without regard to case, and two columns of one name do not
fit; partition columns come from the directories and are not looked for in the
files; a file without a readable footer does not fit. Files and directories
whose name starts with ``_`` or ``.`` are no data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES_PER_TASK = 500  # footers that a task reads, about


def _same_kind(have: pa.DataType, want: T.DataType) -> bool:
    """Whether a Parquet column of type ``have`` can be read as ``want``."""
    if isinstance(want, T.ArrayType):
        return (pa.types.is_list(have) or pa.types.is_large_list(have)) and _same_kind(have.value_type, want.elementType)
    if isinstance(want, T.StructType):
        return pa.types.is_struct(have) and misfit(list(have), want.fields) is None
    kinds = {
        T.StringType: (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary),
        T.IntegerType: (pa.types.is_int8, pa.types.is_int16, pa.types.is_int32),
        T.LongType: (pa.types.is_int8, pa.types.is_int16, pa.types.is_int32, pa.types.is_int64),
        T.DoubleType: (pa.types.is_float32, pa.types.is_float64),
        T.BooleanType: (pa.types.is_boolean,),
        T.DateType: (pa.types.is_date32,),
        T.TimestampType: (pa.types.is_timestamp,),
    }
    return any(test(have) for test in kinds.get(type(want), ()))


def misfit(columns: Iterable[pa.Field], wanted: list[T.StructField]) -> str | None:
    """Why a file with these columns can't be read under the wanted ones, None if it can."""
    by_name: dict[str, list[pa.Field]] = {}
    for c in columns:
        by_name.setdefault(c.name.lower(), []).append(c)
    for field in wanted:
        have = by_name.get(field.name.lower(), [])
        if len(have) > 1:
            return f"{field.name}: {len(have)} columns of this name"
        if have and not _same_kind(have[0].type, field.dataType):
            return f"{field.name}: {have[0].type} instead of {field.dataType.simpleString()}"
    return None


def _footer_misfit(path: str, wanted: list[T.StructField]) -> str | None:
    try:
        if urlparse(path).scheme in ("", "file"):
            store, place = pafs.LocalFileSystem(), unquote(urlparse(path).path)
        else:
            store, place = pafs.FileSystem.from_uri(path)
        with store.open_input_file(place) as file:
            columns = pq.ParquetFile(file).schema_arrow
    except pa.ArrowInvalid as e:  # no Parquet; a store that can't be reached fails the job instead
        return f"no readable footer: {str(e)[:200]}"
    return misfit(columns, wanted)


def check_footers(spark: SparkSession, path: str, schema: T.StructType, partition_columns: Iterable[str] = ()) -> DataFrame:
    """(file, reason) of every data file under ``path``; the reason is null where the file fits."""
    apart = {c.lower() for c in partition_columns}
    wanted = [f for f in schema.fields if f.name.lower() not in apart]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(path).select("path")
    )  # names only: neither content nor rows are read

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [_footer_misfit(p, wanted) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["file", "reason"])

    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, "path").mapInArrow(check, "file string, reason string")


def read_fitting(
    spark: SparkSession, path: str, schema: T.StructType, partition_columns: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows of the files that fit, (file, reason) of those that do not).

    Directories in which every file fits are read as a whole; only where one does
    not are the others named one by one.
    """
    checked = check_footers(spark, path, schema, partition_columns).withColumn(
        "folder", F.regexp_replace("file", "/[^/]*$", "")
    )
    checked = checked.persist()  # one pass over the footers for the folders, the names and the report
    folders = checked.groupBy("folder").agg(F.count("reason").alias("bad")).persist()
    bad = checked.filter("reason is not null").select("file", "reason")
    report = spark.createDataFrame(bad.collect(), "file string, reason string")  # as many rows as files that do not fit
    if report.isEmpty():
        places = [path]
    else:
        mixed = folders.filter("bad > 0").select("folder")
        named = checked.filter("reason is null").join(mixed, "folder", "left_semi")
        places = [r[0] for r in folders.filter("bad = 0").select("folder").unionAll(named.select("file")).collect()]
    folders.unpersist()
    checked.unpersist()
    reader = spark.read.schema(schema).option("basePath", path)
    rows = reader.parquet(*places) if places else spark.createDataFrame([], schema)
    return rows, report
