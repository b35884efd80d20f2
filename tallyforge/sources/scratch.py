"""Paths in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder (one of our own only where it names none and runs on one machine); it goes when the session ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        at = spark.sparkContext.getCheckpointDir()
    at = f"{at.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return at


def drop(spark: SparkSession, at: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
