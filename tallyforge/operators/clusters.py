"""Answer clusters, relative scores and cluster features.

Candidates of one question with one answer are a cluster; a candidate without an answer is a cluster of its own. All windows
and aggregates share the question as their first key, so one shuffle by it serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def question() -> WindowSpec:
    return Window.partitionBy("question_uid")


def best_first() -> WindowSpec:
    """The best candidate of a question is the first of the highest score."""
    return question().orderBy(F.desc_nulls_last("rm"), "candidate_index")


def cluster_key() -> Column:
    return F.coalesce(F.concat(F.lit("a:"), F.col("answer")), F.concat(F.lit("u:"), F.col("candidate_index").cast("string")))


def raw_choice(cand: DataFrame) -> DataFrame:
    """The first candidate of the highest score in each question."""
    return cand.withColumn("r", F.row_number().over(best_first())).where("r = 1").drop("r")


def with_robust_z(df: DataFrame, x: str = "rm", out: str = "z", keys: tuple[str, ...] = ("question_uid",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    df = df.withColumns({"__mid": F.median(x).over(w), "__sd": F.stddev_pop(x).over(w)})
    df = df.withColumn("__mad", 1.4826 * F.median(F.abs(F.col(x) - F.col("__mid"))).over(w))
    scale = F.when(F.col("__mad") >= 1e-6, F.col("__mad")).when(F.col("__sd") >= 1e-6, F.col("__sd")).otherwise(F.lit(1.0))
    return df.withColumn(out, (F.col(x) - F.col("__mid")) / scale).drop("__mid", "__sd", "__mad")


def with_z(df: DataFrame, x: str = "rm", out: str = "z", keys: tuple[str, ...] = ("question_uid",), least: float = 1e-6) -> DataFrame:
    """(x - mean) / population deviation; 0 where that is below least."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"__m": F.avg(x).over(w), "__sd": F.stddev_pop(x).over(w)})
    return df.withColumn(out, F.when(F.col("__sd") < least, F.lit(0.0)).otherwise((F.col(x) - F.col("__m")) / F.when(F.col("__sd") >= least, F.col("__sd")))).drop("__m", "__sd")


def canonical_solution(text: str = "solution") -> Column:
    """Hash of the text with white space collapsed, trimmed, in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))), 256)


def clusters(cand: DataFrame) -> DataFrame:
    """One row for each cluster: size, distinct solutions, best score, first index, label share."""
    return cand.groupBy("question_uid", cluster_key().alias("cluster")).agg(
        F.max("answer").alias("answer"), F.count("*").alias("n"), F.count_distinct(canonical_solution()).alias("unique_solutions"),
        F.max("rm").alias("rm_max"), F.min("candidate_index").alias("first_index"), F.avg("label").alias("label_share"),
    )


def cluster_features(cand: DataFrame) -> DataFrame:
    """log1p(n), n/N, log1p(unique), max, mean, log-mean-exp and deviation of robust z, and whether it holds the raw choice."""
    z = with_robust_z(cand).withColumn("cluster", cluster_key())
    own = Window.partitionBy("question_uid", "cluster")
    z = z.withColumns({"top": F.max("z").over(own), "place": F.row_number().over(best_first()), "total": F.count("*").over(question())})
    return z.groupBy("question_uid", "cluster").agg(
        F.min("candidate_index").alias("first_index"), F.log1p(F.count("*")).alias("log_size"), (F.count("*") / F.first("total")).alias("share"),
        F.log1p(F.count_distinct(canonical_solution())).alias("log_unique"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"),
        (F.first("top") + F.ln(F.avg(F.exp(F.col("z") - F.col("top"))))).alias("z_lme"), F.stddev_pop("z").alias("z_std"),
        F.max((F.col("place") == 1).cast("int")).alias("has_raw"),
    )


def trainable(cand: DataFrame) -> DataFrame:
    """Questions that have a mostly right and a mostly wrong cluster."""
    c = clusters(cand).groupBy("question_uid").agg(F.bool_or(F.col("label_share") >= 0.5).alias("p"), F.bool_or(F.col("label_share") < 0.5).alias("q"))
    return c.where("p AND q").select("question_uid")


def log_sum_exp(x: Column, top: Column) -> Column:
    """As an aggregate; top: the group's largest x."""
    return top + F.ln(F.sum(F.exp(x - top)))
