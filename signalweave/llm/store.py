"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other
    session a folder below the warehouse, which is shared as well.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = getattr(spark, "_signalweave_dir", None)
        if made is None:
            made = "file://" + tempfile.mkdtemp(prefix="spark-signalweave-")
            spark._signalweave_dir = made
        return made
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_signalweave"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/signalweave-{uuid.uuid4().hex}/{name}"


#: Whether Spark deletes an execution's shuffle files when it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files: its result is on the shared folder."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: What ``scratch`` blocks that have not ended have written.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written inside, but those given to the function that it gives.

    Nothing that is executed inside, counts and what goes to the driver included,
    leaves shuffle files.  What leaves the block must not be read from the deleted
    tables later.
    """
    mine: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._signalweave_path)
        return df

    _scopes.append(mine)
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            yield keep
        else:
            with _without_shuffle_files(spark):
                yield keep
    finally:
        _scopes.pop()
        for spark, path in mine:
            if path not in kept:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    This cuts the lineage, survives the loss of executors, and gives the
    planner the true size of what follows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._signalweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote."""
    path = getattr(df, "_signalweave_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


#: Rows of keys, of a few dozen bytes each, up to which they are sent to all tasks.
SENT_KEYS = 1_000_000


def sent(keys: DataFrame, most: int = SENT_KEYS) -> DataFrame:
    """``keys``, marked to be broadcast if there are no more than ``most``; more of them meet the other side in a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys
