"""A folder for files that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_all() -> None:
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where that is unset, the temporary folder."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", master := spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} has no folder that its driver and executors share")
    return f"file://{tempfile.gettempdir()}"


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared folder, deleted at the end."""
    path = f"{shared_folder(spark)}/beamloom-files-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def landed(table: DataFrame) -> DataFrame:
    """The table written to a workspace and read back: what comes after it starts from files, however often it is used."""
    path = workspace(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
