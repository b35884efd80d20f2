"""pass@k, best@k and budget tables. Questions of fewer than k candidates have no value at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import question


def comb_share(a: Column, n: Column, k: Column) -> Column:
    """C(a, k) / C(n, k) as a product of k factors; 0 where a < k. k must be at least 1 and at most n."""
    terms = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: (a - i).cast("double") / (n - i))
    return F.when(a < k, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(1.0), lambda x, y: x * y))


def budgets(spark: SparkSession, ks: list[int]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))


def _with_k(df: DataFrame, ks: list[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))


def pass_at_k(cand: DataFrame, ks: list[int]) -> DataFrame:
    """1 - C(n - c, k) / C(n, k)."""
    q = cand.groupBy("question_uid").agg(F.count("*").alias("n"), F.sum("label").alias("c"))
    return _with_k(q, ks).where("n >= k").select("question_uid", "k", (1 - comb_share(F.col("n") - F.col("c"), F.col("n"), F.col("k"))).alias("pass_at_k"))


def best_at_k(cand: DataFrame, ks: list[int], score: str = "rm") -> DataFrame:
    """Chance that the best-scored of k random candidates is right: sum over right ones, at rank r, of C(n-r-1, k-1) / C(n, k)."""
    w = question().orderBy(F.desc_nulls_last(score), "candidate_index")
    c = cand.select("question_uid", "label", (F.row_number().over(w) - 1).alias("r"), F.count("*").over(question()).alias("n"))
    c = _with_k(c, ks).where("n >= k")
    # C(n-r-1, k-1) / C(n, k) = C(n-r-1, k-1) / C(n-1, k-1) * k / n
    part = F.when(F.col("k") == 1, F.lit(1.0)).otherwise(comb_share(F.col("n") - F.col("r") - 1, F.col("n") - 1, F.greatest(F.col("k") - 1, F.lit(1)))) * F.col("k") / F.col("n")
    return c.groupBy("question_uid", "k").agg(F.sum(F.when(F.col("label") == 1, part).otherwise(0.0)).alias("best_at_k"))


def budget_table(cand: DataFrame, ks: list[int], score: str = "rm") -> DataFrame:
    both = pass_at_k(cand, ks).join(best_at_k(cand, ks, score), ["question_uid", "k"])
    total = cand.agg(F.count_distinct("question_uid").alias("total_questions"))
    t = both.groupBy("k").agg(F.count("*").alias("eligible_questions"), F.avg("pass_at_k").alias("pass_at_k"), F.avg("best_at_k").alias("selection_at_k")).crossJoin(F.broadcast(total))
    return t.select("k", "eligible_questions", "total_questions", (F.col("eligible_questions") / F.col("total_questions")).alias("coverage"), "pass_at_k", "selection_at_k", (F.col("pass_at_k") - F.col("selection_at_k")).alias("oracle_gap"))


def prefix_pass(cand: DataFrame, ks: list[int]) -> DataFrame:
    """Whether any of the first k candidates is right."""
    q = _with_k(cand, ks).groupBy("question_uid", "k").agg(F.max(F.when(F.col("candidate_index") < F.col("k"), F.col("label")).otherwise(0)).alias("hit"))
    return q.groupBy("k").agg(F.count("*").alias("questions"), F.avg("hit").alias("prefix_pass"))
