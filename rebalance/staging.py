"""Intermediate tables on the shared folder that ``spark.checkpoint.dir`` names.

A table that several jobs read, or whose row ids must not change, is written
once and read back. That cuts the lineage, survives the loss of executors and
gives Catalyst the true size of the table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; local sessions get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rebalance-"))
    return spark.sparkContext.getCheckpointDir()


_written: list[str] = []  # outside any run
_run: ContextVar[str | None] = ContextVar("run", default=None)
_seen: set[tuple[str, str]] = set()


def _check_shared(spark: SparkSession, folder: str) -> None:
    """Refuse a folder of the driver's own disk on a cluster.

    A ``file:`` folder may be a mount that all machines share. So the driver writes a
    marker there once, and an executor has to find it.
    """
    app = (spark.sparkContext.applicationId, folder)
    if spark.sparkContext.master.split("[")[0] == "local" or app in _seen:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marker-{uuid.uuid4().hex}.txt")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        out = fs.create(path)
        out.write(b"shared\n")
        out.close()
        try:
            found = spark.read.text(path.toString()).count()
        except Exception as e:  # the reader's own words vary
            raise ValueError(f"{folder} is not shared with the executors") from e
        if found != 1:
            raise ValueError(f"{folder} is not shared with the executors")
        fs.delete(path, False)
    _seen.add(app)


def new_path(spark: SparkSession, name: str) -> str:
    folder = checkpoint_dir(spark).rstrip("/")
    _check_shared(spark, folder)
    if _run.get():
        return f"{_run.get()}/{name}-{uuid.uuid4().hex}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged so far outside of runs, once no result that reads them is needed."""
    while _written:
        _delete(spark, _written.pop())


@contextmanager
def staging_run(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is staged inside the block, deleted at its end.

    Results made in the block must have been written by then. What was staged outside
    the block, or in a run around it, stays.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        _delete(spark, folder)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table staged at ``path`` that nothing reads any more."""
    if path in _written:
        _written.remove(path)
    _delete(spark, path)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once, to ``path`` if that is given, and return the written table."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``stage`` that also returns aggregates gathered while writing."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return staged, seen.get
