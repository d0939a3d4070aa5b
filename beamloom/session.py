"""Session helpers: settings that the engine's plans rely on, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "beamloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; a cluster's own settings stay where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that its kernels can be imported there."""
    context = spark.sparkContext
    if getattr(context, "_beamloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="beamloom-ship-"), "beamloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("beamloom", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._beamloom_shipped = True
