"""The shared folder: written tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The paths written in each scratch() that is open, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())
#: Folders of sessions that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or given to the context; a temporary one only where neither is and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="worldfold-")
        named = _OWN[app]
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted at the end of the scratch() around it."""
    path = f"{shared_dir(spark)}/worldfold/{name}-{uuid.uuid4().hex}"
    if held := _OPEN.get():
        held[-1].append(path)
    return path


#: Parquet options for a log: columns of which every row has its own value need no dictionary.
UNLISTED = {f"parquet.enable.dictionary#{c}": "false" for c in ("seq", "id", "asserted_at")}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a plan break that any executor can reread."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """written(), and then the shuffle files of what made it are let go of.

    They are deleted once the driver's JVM finds the finished plan unreachable, which it may not look for in hours; a
    program of several large jobs asks for it, so that disks hold the shuffles of one job at a time.
    """
    out = written(df, name)
    del df
    release(out.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    for _ in range(2):  # the plan that just ended is still on its way through the listeners
        time.sleep(0.4)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table that no pending plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those kept()."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            drop(spark, path)


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """written(), but left to what is around the innermost scratch()."""
    token = _OPEN.set(_OPEN.get()[:-1])
    try:
        return written(df, name, **options)
    finally:
        _OPEN.reset(token)
