"""A summary kept day by day, so that a rerun of one day reads one day.

Beside an output partitioned by day lies ``<output>_summary_parts``: the summary
of each day as a partition of its own, and a manifest that says from which data
files (names and bytes) each day's part was made. A day whose files are not
those of the manifest is stale and summarised anew; the others are not read.
Days that are gone from the output go from the parts. The whole summary is the
parts together, since its keys hold the day.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.sinks.publish import Folder, recover
from innsight.sinks.writers import read_partitioned, write_partitioned

MANIFEST = "_manifest.json"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder name of a null


def parts_path(output_path: str) -> str:
    return output_path.rstrip("/") + "_summary_parts"


def day_files(spark: SparkSession, output_path: str, date_parts: Sequence[str]) -> dict[str, list]:
    """Partition folder -> [[file, bytes], ...] of an output partitioned by ``date_parts``."""
    output = Folder(spark, output_path)
    return {day: [list(f) for f in output.files(day)] for day in output.subfolders(len(date_parts))}


def read_manifest(spark: SparkSession, output_path: str) -> dict[str, list]:
    return json.loads(Folder(spark, parts_path(output_path)).read_text(MANIFEST) or "{}")


def _on_days(days: list[str], schema: T.StructType) -> Column:
    """The rows of the given partition folders; prunes directories."""

    def part(text: str) -> Column:
        name, _, value = text.partition("=")
        return F.col(name).isNull() if value == NO_VALUE else F.col(name) == F.lit(value).cast(schema[name].dataType)

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(part, day.split("/"))) for day in days])


def refresh_parts(
    spark: SparkSession,
    output_path: str,
    schema: T.StructType,
    date_parts: Sequence[str],
    summarise: Callable[[DataFrame], DataFrame],
) -> list[str]:
    """Bring the day parts up to the output; returns the days that were summarised anew.

    ``summarise`` maps rows of the output to their summary, whose keys include
    ``date_parts``.
    """
    parts = parts_path(output_path)
    recover(spark, parts)
    now, known = day_files(spark, output_path, date_parts), read_manifest(spark, output_path)
    stale = [day for day, files in now.items() if known.get(day) != files]
    kept = {day: files for day, files in known.items() if now.get(day) == files}
    folder = Folder(spark, parts)
    if kept != known:
        # what the manifest lists is always there: a day leaves the list before its part changes
        folder.write_text(MANIFEST, json.dumps(kept))
    for day in set(folder.subfolders(len(date_parts))) - set(now):
        folder.delete(day)
    if stale:
        rows = read_partitioned(spark, output_path, schema)
        rows = rows.filter(_on_days(stale, schema)) if kept else rows
        made = write_partitioned(summarise(rows), parts, date_parts, replace_partitions_only=True)
        for day in set(stale) - set(made):  # no rows any more
            folder.delete(day)
        folder.write_text(MANIFEST, json.dumps(kept | {day: now[day] for day in stale}))
    return stale


def read_summary(spark: SparkSession, output_path: str, schema: T.StructType) -> DataFrame:
    """The whole summary, from its day parts."""
    parts = parts_path(output_path)
    if not Folder(spark, parts).subfolders(1):
        return spark.createDataFrame([], schema)
    return read_partitioned(spark, parts, schema).select(*schema.names)
