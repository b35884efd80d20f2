"""An extension: scores that arrive as a stream update each question's running choice.

State is one row for each question (its best candidate so far), kept as Parquet versions in the shared folder: each micro-batch
reads the last version, merges and writes the next, so a batch that is run again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def best(df: DataFrame) -> DataFrame:
    first = Window.partitionBy("question_uid").orderBy(F.desc_nulls_last("rm"), "candidate_index")
    return df.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def upsert(spark: SparkSession, state: str, columns: list[str]):
    """A function for foreachBatch that keeps the best candidate of each question under state/version=N."""

    def run(batch: DataFrame, number: int) -> None:
        new = best(batch.select(*columns))
        if number:
            new = best(new.unionByName(batch.sparkSession.read.parquet(f"{state}/version={number - 1}").select(*columns)))
        new.write.mode("overwrite").parquet(f"{state}/version={number}")

    return run


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling windows; later than the watermark they are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
