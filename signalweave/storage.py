"""Cutting the plan of a table, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the plan with a reliable checkpoint."""
    _folder(df.sparkSession)
    # Kept while it is written, or the plan would run once for the data and once for the file.
    held = df.persist()
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


#: Whether Spark deletes an execution's shuffle files when it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cuts the plan with a Parquet table, for rounds: no shuffle files are left, and ``discard`` deletes it when the next one is there."""
    spark: SparkSession = df.sparkSession
    path = f"{_folder(spark)}/round-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._signalweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` wrote."""
    path = getattr(df, "_signalweave_path", None)
    if path is not None:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
