"""Makes this package importable in the Python workers of a session, and bounds what travels to them at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Spark's own bound of a batch for Python workers, and ours: texts are long, and each worker holds a batch a few times.
_BATCH, _SPARKS_BATCH, _OURS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once per application, and sets batches to ``_OURS`` bytes unless the session has a bound of its own.

    ``spark-submit --py-files`` does the same; this saves callers that start a
    plain session from having to know about it.
    """
    if spark.conf.get(_BATCH, _SPARKS_BATCH) == _SPARKS_BATCH:
        spark.conf.set(_BATCH, _OURS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-pyfiles-"), "signalweave.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
