"""Intermediate tables in the folder that all executors share.

A stored table cuts the lineage of an iterative job, survives the loss of an
executor and gives the planner exact sizes.  The folder is the one the session
names in ``spark.checkpoint.dir``; only a session on one machine may go without.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; sets a temporary one only on a ``local`` master."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lociframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(SETTING, folder)
    return folder


#: Folders of the jobs of this process, with their sessions, and what else is to be undone with them.
_ROOTS: dict[str, SparkSession] = {}
_UNDONE: dict[str, Callable[[], None]] = {}


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_tables() -> None:
    """Delete the intermediate tables of this process; DataFrames that read them can't be used any more."""
    _remove(list(_ROOTS))


def _remove(roots: list[str]) -> None:
    for root in roots:
        spark, undo = _ROOTS.pop(root), _UNDONE.pop(root, None)
        try:
            if undo:
                undo()
            delete_folder(spark, root)
        except Exception:  # noqa: BLE001 - a session that has ended can't delete; its folder is then left
            continue


@contextmanager
def scoped_tables() -> Iterator[None]:
    """Delete the intermediate tables that are made within, at the end; results must have been written by then."""
    before = set(_ROOTS)
    try:
        yield
    finally:
        _remove([root for root in _ROOTS if root not in before])


atexit.register(remove_tables)


class Workspace:
    """Numbered parquet tables of one job under the shared folder.

    They are deleted at the end of :func:`scoped_tables`, or by :func:`remove_tables`, which
    runs when the process ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = spark
        self._n = 0

    def at_removal(self, undo: Callable[[], None]) -> None:
        """Run ``undo`` before the tables are deleted."""
        _UNDONE[self.root] = undo

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._workspace_path = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that no later step reads."""
        for table in tables:
            if path := getattr(table, "_workspace_path", None):
                delete_folder(self.spark, path)
