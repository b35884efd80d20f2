"""What the operators share: the shared folder, scratch tables, word rules and row keys."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a maximal run of ASCII digits, ASCII letters (lower-cased first) and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their working directory is."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Arrow batches of whole texts: few rows and bytes each, since a text may be long. Smaller settings of the session stay;
    larger ones are replaced, and stay so, since a plan reads them when it runs."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        own = (spark.conf.get(key, None) or "0").lower().removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; one of our own only where the session names none and runs on one machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not (at := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session ends."""
    at = f"{shared_dir(spark).rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def kept(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    at = at or scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_scratch(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of tables that nobody holds any more go from the executors' disks. Spark's cleaner removes them once the
    driver's JVM has collected its garbage, which by itself may take half an hour (spark.cleaner.periodicGC.interval)."""
    gc.collect()
    time.sleep(1.5)  # the JVM hears within a second of what Python has let go
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is faster and does just that on pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that no column of df has."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
