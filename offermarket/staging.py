"""Tables written once so that later steps read them instead of recomputing.

The files go to the shared folder named by ``spark.checkpoint.dir``: every
executor can read them, and they survive the loss of any executor. A table
that was written has a known size, so Catalyst decides by itself, from
``spark.sql.autoBroadcastJoinThreshold``, whether a join may broadcast it.
Each application has a folder of its own, which ``clear`` removes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}
_clearings: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, in local mode only, one that goes with the process."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="offermarket-")
        atexit.register(shutil.rmtree, _local_dirs[application], ignore_errors=True)
    return _local_dirs[application]


def application_folder(spark: SparkSession) -> str:
    """What this application stages lies below this folder."""
    return f"{shared_dir(spark)}/offermarket/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder; nothing is ever overwritten."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet, with the writer's options if given, and return a scan of the files."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generation(spark: SparkSession) -> int:
    """How often this application's folder was cleared: what is staged in one generation is gone in the next."""
    return _clearings.get(application_folder(spark), 0)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has staged; frames that read it can't be used any more."""
    folder = application_folder(spark)
    _clearings[folder] = _clearings.get(folder, 0) + 1
    system, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[SparkSession]:
    """Whatever is staged inside goes at the end: write results elsewhere before."""
    try:
        yield spark
    finally:
        clear(spark)
