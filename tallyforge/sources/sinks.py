"""Sinks: JSON lines, manifests, hashes, parts that can be resumed."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """By Spark's committer: readers see all of it or nothing. Refuses an existing path unless told to replace it."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def _named(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def publish(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> str:
    """A small file that appears at once, on any file system that Spark can open: written under another name, then renamed. Returns
    its hash."""
    store, name = _named(spark, path)
    if store.exists(name) and not overwrite:
        raise FileExistsError(path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name.getParent(), f".{name.getName()}.{uuid.uuid4().hex}.new")
    out = store.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    if overwrite:
        store.delete(name, False)
    if not store.rename(new, name):
        store.delete(new, False)
        raise FileExistsError(path)  # another writer was faster
    return hashlib.sha256(text.encode()).hexdigest()


def stored(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, if it is there."""
    store, name = _named(spark, path)
    if not store.exists(name):
        return None
    source = store.open(name)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def write_manifest(value: dict, path: str, overwrite: bool = False) -> str:
    """A small JSON file that appears at once; returns its hash."""
    spark = SparkSession.getActiveSession()
    return publish(spark, str(path), json.dumps(plain(value), ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n", overwrite)


def plain(value):
    """JSON-ready: numpy scalars and arrays to Python's, NaN and infinities to null, keys to text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def canonical_hash(value, length: int | None = None) -> str:
    """SHA-256 of JSON with sorted keys and tight separators."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def record_hash(*columns: Column) -> Column:
    """The same over columns: keys in sorted order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no finished part has."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(df: DataFrame, path: str, keys: list[str], work) -> int:
    """Appends work(rows still missing at path); returns how many there were. A rerun does only what is left."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    left = pending(df, spark.read.parquet(path), keys) if there else df
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


def merge_versions(primary: DataFrame, recovered: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Recovered values where there are any, the primary ones beside them as primary_…, and which of the two counts."""
    r = recovered.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__found"))
    j = primary.join(r, keys, "left")
    found = F.coalesce(F.col("__found"), F.lit(False))
    return j.select(
        *[c for c in primary.columns if c not in columns], *[F.when(found, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        *[F.when(found, F.col(c)).alias(f"primary_{c}") for c in columns], F.when(found, "recovery").otherwise("primary").alias("stage"),
    )
