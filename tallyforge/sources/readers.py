"""Sources: JSON lines and documents, nested records, Parquet, arrays, datasets with checks."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .documents import elements


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One record for each line that isn't blank; a bad line is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, and a column _bad that holds the text of a line which isn't one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("x")).select("x.*")


def invalid_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count("_bad").alias("invalid"))


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file that is one JSON array or object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that are each one JSON array (or one object), read by ranges of bytes; one that isn't JSON is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return elements(spark, path).select(parsed.alias("x")).select("x.*")


def nested_records(spark: SparkSession, path: str, needs: str) -> DataFrame:
    """Every object at any depth of JSON files that has the key needs, as JSON text, with its file. The elements of a file's outermost
    array are searched by as many tasks as it has ranges of bytes; a file that is one object, by one."""

    def walk(value) -> Iterator[dict]:
        if isinstance(value, dict):
            if needs in value:
                yield value
            value = value.values()
        elif not isinstance(value, list):
            return
        for x in value:
            yield from walk(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, json.dumps(x, ensure_ascii=False, sort_keys=True)) for p, c in zip(b["path"], b["value"], strict=True) for x in walk(json.loads(c))]
            yield pd.DataFrame(found, columns=["path", "record"])

    return elements(spark, path).mapInPandas(run, "path string, record string")


def records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reader by suffix: .jsonl, .json or Parquet."""
    if path.endswith((".jsonl", ".jsonl.gz")):
        df = json_lines(spark, path)
    elif path.endswith(".json"):
        df = json_document(spark, path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .npy files: file, place in it, and its numbers. Each file is one task's; scores that come as one huge array should
    be cut before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(bytes(c)), allow_pickle=False)
                a = a.reshape(len(a), int(np.prod(a.shape[1:]))).astype(float)
                for lo in range(0, len(a), 4096):
                    part = a[lo : lo + 4096]
                    yield pd.DataFrame({"path": p, "place": np.arange(lo, lo + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place bigint, v array<double>")


def checked(df: DataFrame, rows: int) -> DataFrame:
    """df, if it has so many rows."""
    if (n := df.count()) != rows:
        raise ValueError(f"{n} rows where {rows} are due")
    return df


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_keyed(df: DataFrame, *keys: str) -> DataFrame:
    if bad := repeated_keys(df, *keys).take(1):
        raise ValueError(f"{keys} isn't unique: {bad[0].asDict()}")
    return df


def first_text(columns: list[Column], least: int = 20) -> Column:
    """The first of several texts that has least characters, trimmed."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) >= least, F.trim(c)) for c in columns])


def joined_text(parts: Column) -> Column:
    """A list of texts as one: blank ones left out, the others trimmed, a line each."""
    return F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), "\n")


def attach_scores(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores by key, where every row must have one and every score a row."""
    joined = rows.join(scores.withColumn("__s", F.lit(True)), keys, "left")
    # in a key, since a column that nobody reads would never be computed
    key = F.when(F.col("__s").isNull(), F.raise_error(F.lit("a row without a score"))).otherwise(F.col(keys[0]))
    return joined.withColumn(keys[0], key.cast(rows.schema[keys[0]].dataType)).drop("__s")
