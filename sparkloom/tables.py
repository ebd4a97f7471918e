"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[list[Saved] | None] = ContextVar("open", default=None)
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    In local mode, where driver and executors are one process, a temporary
    folder stands in for the setting; on a cluster it must be set.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[context.applicationId]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store with all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Saved:
    """A DataFrame written to the shared folder as Parquet, which cuts its lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if (own := _OPEN.get()) is not None:
            own.append(self)

    def drop(self) -> None:
        remove(self.spark, self.path)


class Scope:
    """The tables saved inside ``scope()``."""

    def __init__(self, mine: list[Saved]):
        self.mine = mine
        self.kept: list[Saved] = []

    def keep(self, table: Saved) -> DataFrame:
        """The table's rows; it outlives this scope (an outer one may end it)."""
        self.kept.append(table)
        return table.df

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, kept if it is a table of this scope, saved and kept if it may read some."""
        own = [table for table in self.mine if table.df is df]
        if own or not self.mine:
            return self.keep(own[0]) if own else df
        return self.keep(Saved(df, name))


@contextmanager
def scope() -> Iterator[Scope]:
    """Deletes the tables saved inside at its end, but for those kept, which go
    to the scope around it, if there is one."""
    mine: list[Saved] = []
    outer = _OPEN.get()
    token = _OPEN.set(mine)
    found = Scope(mine)
    try:
        yield found
    finally:
        _OPEN.reset(token)
        for table in mine:
            if table not in found.kept:
                table.drop()
            elif outer is not None:
                outer.append(table)
