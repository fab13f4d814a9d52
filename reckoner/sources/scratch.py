"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, in the application's own. Where that is unset, below the machine's temp folder if driver and executors are one process (local tests); on a cluster that would lose rows, so it is an error there."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "reckoner-shared")
    return f"{top.rstrip('/')}/reckoner/{spark.conf.get('spark.app.id', 'application')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
