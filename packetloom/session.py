"""Session settings that the engine relies on or profits from, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

#: Rows of whole texts that one Arrow batch may have: batches lie outside the heap, on both sides, and texts may be long.
BATCH_ROWS = 512
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    return configure(builder.config(map={k.replace("__", "."): v for k, v in extra.items()}).getOrCreate())


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="checkpoints-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Where it is unset, a temporary one if all tasks run
    in the driver; on a cluster each executor would write to a disk of its own, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or _own_folder()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
