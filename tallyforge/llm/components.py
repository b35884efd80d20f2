"""Connected components of links, by alternating star contractions over DataFrames; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: A hot centre's links meet its least neighbour in as many tasks.
SALTS = 8


def _with_least(at: DataFrame, least: DataFrame) -> DataFrame:
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return at.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])


def _stars(links: DataFrame, wide: bool) -> DataFrame:
    """links: distinct (a, b) with a < b. wide: larger neighbours move to the least neighbour; else smaller ones do."""
    if wide:
        at = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = at.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = _with_least(at, least).where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        at = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = at.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(at, least).select(F.col("m").alias("a"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"))
    return out.where(F.col("a") < F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links (a, b) in any order and number; out: id and root, the least id of its component, for each id that has a link."""
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    spark, before = links.sparkSession, None
    now = common.kept(now, "links", place := common.scratch(spark, "links"))
    for _ in range(rounds):
        print_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if print_ == before or not print_.n:
            break
        before, old, place = print_, place, common.scratch(spark, "links")
        now = common.kept(_stars(_stars(now, True), False), "links", place)
        common.drop_scratch(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
