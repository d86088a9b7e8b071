"""Lineage cuts that survive executor loss, and scratch places tied to a job.

A cut writes the DataFrame as Parquet into the shared folder named by
``spark.checkpoint.dir`` and reads it back, so a lost executor does not lose the
result and later stages restart from the files. Compared with
``Dataset.checkpoint`` the plan runs once, the data is stored columnar, and the
re-read scan carries the real file size, which the planner uses for its join
choices. Where no folder is named the frame is persisted instead (memory and
disk, recomputed from its lineage when lost). Local checkpoints are never used.

Everything a job leaves behind belongs to its ``Cuts`` handle and goes when the
handle is released -- at the end of ``job_cuts`` whether or not the job failed,
or at the end of the process for frames handed to a caller.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Cuts:
    """What one job has written or persisted on the side."""

    def __init__(self) -> None:
        self._undo: list[Callable[[], object]] = []
        self.paths: list[str] = []

    def add(self, undo: Callable[[], object]) -> None:
        self._undo.append(undo)

    def add_path(self, spark: SparkSession, path: str) -> None:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.paths.append(path)
        self.add(lambda: fs.delete(jpath, True))

    def release(self) -> int:
        """Delete the folders, unpersist the frames; returns how many there were."""
        n = 0
        while self._undo:
            with contextlib.suppress(Exception):  # the session may be gone already
                self._undo.pop()()
            n += 1
        self.paths.clear()
        return n


#: for frames that a caller goes on using; released when the process ends
PROCESS_CUTS = Cuts()
atexit.register(PROCESS_CUTS.release)
_CURRENT: contextvars.ContextVar[Cuts] = contextvars.ContextVar("innsight_cuts", default=PROCESS_CUTS)


def current_cuts() -> Cuts:
    return _CURRENT.get()


@contextlib.contextmanager
def job_cuts() -> Iterator[Cuts]:
    """A handle of its own for the cuts made inside; released at the end, also after an error."""
    cuts = Cuts()
    token = _CURRENT.set(cuts)
    try:
        yield cuts
    finally:
        _CURRENT.reset(token)
        cuts.release()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder: ``spark.checkpoint.dir`` of the session, else the context's; None if neither is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named.rstrip("/") if named else None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder (or the warehouse, which is shared too), owned by the current handle."""
    root = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    path = f"{root}/innsight-{label}-{uuid.uuid4().hex}"
    current_cuts().add_path(spark, path)
    return path


def cut_lineage(df: DataFrame, enabled: bool = True, label: str = "cut") -> DataFrame:
    """Write ``df`` under the shared folder (one job) and return the re-read frame."""
    if not enabled:
        return df
    spark = df.sparkSession
    if checkpoint_dir(spark) is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        current_cuts().add(kept.unpersist)
        return kept
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
