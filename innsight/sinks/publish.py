"""Overwrite an output without a time in which a failed job leaves none.

Spark's overwrite deletes the old files before the new ones are complete. Here
the new output is written to a staging folder beside the old one, and only when
all of it is there is it published: the old folder (or the old partitions) is
set aside, the staged one takes its place, and what was set aside is deleted.
A write that fails leaves the old output as it was.

Publishing itself is a few renames. They are listed in a journal beside the
output before the first one, and ``recover`` -- called by the next write, or by
a reader that finds a journal -- carries an interrupted publication to its end.
On stores without renames (object stores) a rename copies; the order of steps
and the journal are the same.

Everything goes through the file system API of the output's path, so any store
that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Folder:
    """A path in the store that holds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: Folder, to_name: str) -> None:
        """Rename ``name`` in this folder; the target must not be there."""
        target = to._at(to_name)
        if to._fs.exists(target):
            raise FileExistsError(f"{target} is in the way")
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._at(name), target):
            raise OSError(f"{self._at(name)} could not become {target}")

    def subfolders(self, depth: int) -> list[str]:
        """Partition folders ``a=1/b=2/...`` that many levels down, in order."""
        found = self._fs.globStatus(self._at("/".join(["*=*"] * depth))) or []
        parts = [status.getPath().toString().split("/")[-depth:] for status in found if status.isDirectory()]
        return sorted("/".join(p) for p in parts)

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of the data files directly in ``name``, in order."""
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(name)) if s.isFile()]
        return sorted(f for f in found if not f[0].startswith(("_", ".")))

    def write_text(self, name: str, text: str) -> None:
        """Replace a small file; a reader sees the old text, none, or the new one."""
        draft = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(draft), self._at(name))

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def _journal(path: str) -> tuple[str, str]:
    parent, _, name = path.rstrip("/").rpartition("/")
    return parent or ".", f"_{name}_publication.json"


def publish(spark: SparkSession, staging: str, path: str, partitions: list[str] | None = None) -> None:
    """Put the complete output in ``staging`` in the place of ``path``, or only the ``partitions`` named."""
    parent, journal = _journal(path)
    steps = {"staging": staging, "aside": f"{path.rstrip('/')}__aside_{uuid.uuid4().hex}", "partitions": partitions}
    Folder(spark, parent).write_text(journal, json.dumps(steps))
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> bool:
    """Carry on a publication of ``path`` from wherever it stopped; False if there is none.

    Each piece (the whole output, or a partition) is moved aside only while its
    staged successor is there, and the successor takes its place next, so after
    any interruption the same steps lead to the end.
    """
    parent, journal = _journal(path)
    text = Folder(spark, parent).read_text(journal)
    if text is None:
        return False
    steps = json.loads(text)
    new, old, aside = (Folder(spark, p) for p in (steps["staging"], path, steps["aside"]))
    for piece in [""] if steps["partitions"] is None else steps["partitions"]:
        if not new.exists(piece):
            continue  # published before
        if old.exists(piece):
            old.move(piece, aside, piece)
        new.move(piece, old, piece)
    aside.delete()
    new.delete()
    Folder(spark, parent).delete(journal)
    return True


def replace_output(
    spark: SparkSession, path: str, write: Callable[[str], None], partition_depth: int | None = None
) -> list[str] | None:
    """Let ``write`` fill a staging folder and publish it as ``path`` if it succeeds.

    With ``partition_depth`` only the partitions that were written replace those
    of the same name; returns their folders.
    """
    recover(spark, path)
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    try:
        write(staging)
    except BaseException:
        Folder(spark, staging).delete()
        raise
    partitions = None if partition_depth is None else Folder(spark, staging).subfolders(partition_depth)
    publish(spark, staging, path, partitions)
    return partitions
