"""Parts of a long piece of work that a restart checks before it goes on.

Rows are dealt to parts by a hash of their keys. Each part is a folder that takes its name when it is whole (written under another
one, then renamed), and has an entry in a ledger beside it: how many rows, a sum of hashes of their keys, and the settings of the
work. A restart compares the parts with the ledger and with what is to be done: parts that are lost, cut, doubled, changed, or of
other settings are done again, the others aren't touched. All paths go through Hadoop's file systems, so any that Spark can open
will do.

Cases: rows with equal keys are rows each (the sum of hashes counts them). Null keys are keys. No rows: no parts. Rows that a work
adds, loses or renames the keys of are an error, and its parts don't count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import canonical_hash, publish, stored


@dataclass(frozen=True)
class Entry:
    """rows and keys: what a part holds; settings: of the work that made it."""

    rows: int
    keys: str
    settings: str


def _digest(df: DataFrame, part: Column, keys: list[str]) -> dict[int, tuple[int, str]]:
    """Rows and sum of key hashes of each part: as many rows as there are parts."""
    h = F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).cast("string")
    return {r.part: (r.n, r.h) for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), h.alias("h")).collect()}


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts)).cast("int")


def _entry(spark: SparkSession, at: str, part: int) -> Entry | None:
    try:
        return Entry(**json.loads(text)) if (text := stored(spark, f"{at}/ledger/{part:06d}.json")) else None
    except (ValueError, TypeError, Py4JJavaError):  # cut off, or damaged on disk: as if it weren't there
        return None


def _held(spark: SparkSession, at: str, part: int, keys: list[str]) -> tuple[int, str] | None:
    """What a part's folder holds; nothing if it isn't there or can't be read."""
    files, path = spark.sparkContext._jvm.org.apache.hadoop.fs, f"{at}/part-{part:06d}"
    name = files.Path(path)
    if not name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name):
        return None
    try:
        return _digest(spark.read.parquet(path), F.lit(part), keys).get(part, (0, None))
    except (PySparkException, Py4JJavaError):  # a file that can't be read: the part doesn't count
        return None


def audit(spark: SparkSession, at: str, keys: list[str], due: dict[int, tuple[int, str]], settings: dict) -> dict[int, str]:
    """What is wrong with each part that is due: missing (never done), lost, cut, doubled, changed, or of other settings. Parts that
    are right aren't named."""
    found, mark = {}, canonical_hash(settings)
    for part, (rows, h) in sorted(due.items()):
        entry = _entry(spark, at, part)
        held = _held(spark, at, part, keys) if entry else None
        if entry is None:
            found[part] = "missing"
        elif entry.settings != mark:
            found[part] = "other settings"
        elif held is None:
            found[part] = "lost"
        elif held[0] != rows:
            found[part] = "cut" if held[0] < rows else "doubled"
        elif held[1] != h or (entry.rows, entry.keys) != (rows, h):
            found[part] = "changed"
    return found


def run_parts(df: DataFrame, at: str, keys: list[str], work: Callable[[DataFrame], DataFrame], parts: int, settings: dict, at_once: int = 8) -> dict[int, str]:
    """work(df) as parts at the path, at_once of them a job; a rerun does only what ``audit`` names, and returns that. work keeps the rows
    and their keys, and adds columns."""
    spark = df.sparkSession
    rows = df.withColumn("__part", _part(keys, parts))
    due = _digest(rows, F.col("__part"), keys)
    wrong = audit(spark, at, keys, due, settings)
    files, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    todo = sorted(wrong)
    for i in range(0, len(todo), at_once):
        now = todo[i : i + at_once]
        new = f"{at}/_new-{uuid.uuid4().hex}"
        own = rows.where(F.col("__part").isin(now))
        made = work(own.drop("__part")).withColumn("__part", _part(keys, parts))
        made.repartition("__part").write.partitionBy("__part").parquet(new)
        got = _digest(spark.read.parquet(new), F.col("__part"), keys)
        if bad := [p for p in now if got.get(p) != due[p]] or sorted(set(got) - set(now)):
            raise ValueError(f"the work lost, added or changed rows of parts {bad}")
        store = files.Path(at).getFileSystem(conf)
        for p in now:
            name = files.Path(f"{at}/part-{p:06d}")
            store.delete(files.Path(f"{at}/ledger/{p:06d}.json"), False)  # first: a part without an entry doesn't count
            store.delete(name, True)
            if not store.rename(files.Path(f"{new}/__part={p}"), name):
                raise OSError(f"{name} can't take its name")
            publish(spark, f"{at}/ledger/{p:06d}.json", json.dumps(asdict(Entry(*due[p], canonical_hash(settings))), sort_keys=True))
        store.delete(files.Path(new), True)
    return wrong


def read_parts(spark: SparkSession, at: str) -> DataFrame:
    """All parts that have an entry."""
    files, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    book = files.Path(f"{at}/ledger")
    names = [s.getPath().getName() for s in book.getFileSystem(conf).listStatus(book)]
    return spark.read.parquet(*[f"{at}/part-{n.removesuffix('.json')}" for n in sorted(names) if n.endswith(".json")])
