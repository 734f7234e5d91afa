"""What driver and workers share: this package, sent to the workers once per session, and a folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers the package as it is here."""
    sc = spark.sparkContext
    if getattr(sc, "_residua_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="residua-"), "residua.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._residua_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session that names none gets one of its own, on a cluster that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="residua-"))
    return spark.sparkContext.getCheckpointDir()
