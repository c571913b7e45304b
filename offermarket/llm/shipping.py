"""Prepares an application for tasks in Python that work on texts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()
# Spark's own number of rows for a batch suits numbers; whole texts are longer.
BATCH_ROWS, SPARKS_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once an application, as ``--py-files`` would.

    Where the session has Spark's own number of rows for a batch, a smaller one is set,
    which keeps the memory of executors and their Python workers low.
    """
    if spark.conf.get(BATCH_ROWS) == SPARKS_ROWS:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    name = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix=f"{name}-source-")
    # The driver serves the file to executors until the application ends.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, files in os.walk(os.path.join(_ROOT, name)):
            for file in files:
                if file.endswith(".py"):
                    whole = os.path.join(top, file)
                    archive.write(whole, os.path.relpath(whole, _ROOT))
    context.addPyFile(path)
