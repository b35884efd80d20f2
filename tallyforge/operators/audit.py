"""Contracts as counts of violations, so a check is a query and an error only where one asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x)) < float("inf"))


def candidate_contract(cand: DataFrame, forbidden: list[str] = ("answer_key",)) -> DataFrame:
    """One row for each rule: how many questions or rows break it."""
    q = cand.groupBy("question_uid").agg(F.count("*").alias("n"), F.count_distinct("candidate_index").alias("d"), F.min("candidate_index").alias("lo"), F.max("candidate_index").alias("hi"), F.count_if(~finite("rm")).alias("bad"), F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("lab"))
    t = q.agg(
        F.count_if(F.col("n") != F.col("d")).alias("repeated_identity"), F.count_if((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)).alias("incomplete_indices"),
        F.sum("bad").alias("not_finite"), F.sum("lab").alias("bad_label"), F.lit(len(set(forbidden) & set(cand.columns))).cast("bigint").alias("forbidden_fields"),
    )
    return t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in t.columns])))


def require(violations: DataFrame) -> None:
    if bad := violations.where("violations > 0").collect():
        raise ValueError("; ".join(f"{x.rule}: {x.violations}" for x in bad))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Keys that one side lacks, and rows whose values differ."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in same], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in same], F.lit(True).alias("in_b"))
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return x.join(y, keys, "full").agg(F.count_if(F.col("in_b").isNull()).alias("only_left"), F.count_if(F.col("in_a").isNull()).alias("only_right"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & differ).alias("differing"))


def score_contract(scores: DataFrame, expected: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows, missing and unknown keys, repeats, values that aren't finite, and an order-free hash of the content."""
    j = scores.select(*keys, F.col(score).alias("s")).join(expected.select(*keys).withColumn("e", F.lit(1)), keys, "full")
    h = F.sum(F.pmod(F.crc32(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), F.lit(1_000_003)))
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unknown"), F.count_if(F.isnan("s") | (F.abs("s") == float("inf"))).alias("not_finite"), h.alias("key_sum"))


def mixed_groups(cand: DataFrame) -> DataFrame:
    """Candidates of questions that have right and wrong ones."""
    q = cand.groupBy("question_uid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = 0 AND hi = 1")
    return cand.join(q.select("question_uid"), "question_uid", "left_semi")


def groups_of(cand: DataFrame, k: int) -> DataFrame:
    q = cand.groupBy("question_uid").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    return cand.join(q.select("question_uid"), "question_uid", "left_semi")


def split_profile(cand: DataFrame) -> DataFrame:
    q = cand.groupBy("question_uid").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    return q.agg(F.count("*").alias("questions"), F.sum("n").alias("candidates"), F.sum("p").alias("positive"), F.sum(F.col("n") - F.col("p")).alias("negative"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def cluster_purity(cand: DataFrame, key: Column) -> DataFrame:
    """Answered share, and pure clusters among those of two candidates or more."""
    c = cand.where(F.col("answer").isNotNull()).groupBy("question_uid", key.alias("cluster")).agg(F.count_distinct("label").alias("k"), F.count("*").alias("n")).where("n > 1")
    t = c.agg(F.count_if(F.col("k") == 1).alias("pure"), F.count_if(F.col("k") > 1).alias("mixed"))
    return t.select("pure", "mixed", (F.col("pure") / F.greatest(F.col("pure") + F.col("mixed"), F.lit(1))).alias("purity"))
