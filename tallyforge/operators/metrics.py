"""Ranking metrics of scored candidates: question_uid, candidate_index, label, rm (the raw score) and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import best_first, question


def div(a: Column, b: Column) -> Column:
    """NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pair_counts(df: DataFrame, score: str = "score", keys: tuple[str, ...] = ("question_uid",)) -> DataFrame:
    """Right-wrong pairs of each question that the score puts in order, the other way and level, from running sums over equal
    scores: no pair is ever built."""
    at = df.groupBy(*keys, score).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*keys).orderBy(score)) - F.col("q")
    at = at.withColumn("w", F.col("p") * below)
    return at.groupBy(*keys).agg(F.sum("w").alias("wins"), F.sum(F.col("p") * F.col("q")).alias("ties"), (F.sum("p") * F.sum("q")).alias("pairs"))


def question_outcomes(df: DataFrame, score: str = "score") -> DataFrame:
    """For each question whether the raw and the new choice are right, whether they differ, and the pair shares. Pairs are counted
    as in pair_counts, by windows of the question, so that the scores are computed and shuffled once."""
    new, right = question().orderBy(F.desc_nulls_last(score), "candidate_index"), F.col("label")
    level = F.sum(1 - right).over(Window.partitionBy("question_uid", score))
    c = df.withColumns({"a": F.row_number().over(best_first()), "b": F.row_number().over(new), "level": level, "upto": F.sum(1 - right).over(question().orderBy(score).rangeBetween(Window.unboundedPreceding, 0))})
    top = c.groupBy("question_uid").agg(
        F.max(F.when(F.col("a") == 1, right)).alias("raw_right"), F.max(F.when(F.col("b") == 1, right)).alias("new_right"), F.max(((F.col("a") == 1) & (F.col("b") != 1)).cast("int")).alias("switched"),
        F.count("*").alias("n"), F.sum("label").alias("c"), F.sum(right * (F.col("upto") - F.col("level"))).alias("wins"), F.sum(right * F.col("level")).alias("ties"), (F.sum("label") * F.sum(1 - right)).alias("pairs"),
    )
    return top.select("*", div(F.col("wins"), F.col("pairs")).alias("strict"), div(F.col("wins") + 0.5 * F.col("ties"), F.col("pairs")).alias("half_tie")).drop("wins", "ties", "pairs")


def ranking_metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """Means over questions; pair metrics over questions that have both labels."""
    wrong = 1 - F.col("raw_right")
    damage, correction = F.sum(F.col("raw_right") * (1 - F.col("new_right"))), F.sum(wrong * F.col("new_right"))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("questions"), F.avg("new_right").alias("top1"), F.avg("strict").alias("pair_macro_strict"), F.avg("half_tie").alias("pair_macro_half_tie"), F.count("strict").alias("eligible"),
        (damage / F.greatest(F.sum("raw_right"), F.lit(1))).alias("damage_rate"), (correction / F.greatest(F.sum(wrong), F.lit(1))).alias("correction_rate"),
        F.avg("switched").alias("switch_rate"), (correction - damage).alias("net_corrected"),
    )


def composition(df: DataFrame) -> DataFrame:
    q = df.groupBy("question_uid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return q.agg(F.count_if(F.expr("hi = 0")).alias("all_wrong"), F.count_if(F.expr("lo = 0 AND hi = 1")).alias("mixed"), F.count_if(F.expr("lo = 1")).alias("all_correct"))


def tie_diagnostics(df: DataFrame) -> DataFrame:
    """Share of questions with a tied top score, top-1 if the first of them is taken and if any of them is right."""
    q = df.withColumns({"r": F.rank().over(question().orderBy(F.desc("rm"))), "k": F.row_number().over(best_first())}).groupBy("question_uid").agg(
        F.count_if(F.expr("r = 1")).alias("tied"), F.max(F.when(F.col("k") == 1, F.col("label"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("label"))).alias("any"),
        F.avg(F.when(F.col("r") == 1, F.col("label"))).alias("expected"), F.count_distinct("rm").alias("kinds"),
    )
    return q.agg(F.count("*").alias("questions"), F.avg((F.col("tied") > 1).cast("int")).alias("tie_rate"), F.avg("first").alias("top1"), F.avg("any").alias("optimistic_top1"), F.avg("expected").alias("tie_aware_top1"), F.avg((F.col("kinds") == 1).cast("int")).alias("all_equal_rate"))


def auc(df: DataFrame, score: str = "rm") -> DataFrame:
    """Area under the ROC curve over all rows, by rank sums of distinct scores: only these are put in one order."""
    at = df.groupBy(score).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    # runs of scores by range partition: a running sum inside each, and before it the sum of those below
    cut = at.repartitionByRange(score).withColumn("part", F.spark_partition_id())
    runs = cut.groupBy("part").agg(F.sum("q").alias("sq"))
    base = runs.select("part", (F.sum("sq").over(Window.orderBy("part")) - F.col("sq")).alias("before"))
    inside = F.sum("q").over(Window.partitionBy("part").orderBy(score)) - F.col("q")
    w = cut.withColumn("inside", inside).join(F.broadcast(base), "part").select((F.col("p") * (F.col("before") + F.col("inside") + F.col("q") / 2)).alias("u"), "p", "q")
    return w.agg(div(F.sum("u"), F.sum("p") * F.sum("q")).alias("auc"))


def macro(per_dataset: DataFrame, columns: list[str]) -> DataFrame:
    """Unweighted means over data sets."""
    return per_dataset.agg(*[F.avg(c).alias(c) for c in columns])


def gate_audit(df: DataFrame) -> DataFrame:
    """df: label, rm, ungated and gated scores. What the gate did with the switches that the ungated score proposes."""
    w = {x: F.row_number().over(question().orderBy(F.desc(x), "candidate_index")) for x in ("rm", "ungated", "gated")}
    c = df.withColumns({f"r_{k}": v for k, v in w.items()})
    pick = [F.max(F.when(F.col(f"r_{k}") == 1, F.col(x))).alias(f"{k}_{y}") for k in w for x, y in (("candidate_index", "i"), ("label", "ok"))]
    q = c.groupBy("question_uid").agg(*pick)
    proposed = F.col("rm_i") != F.col("ungated_i")
    accepted, rejected = proposed & (F.col("gated_i") == F.col("ungated_i")), proposed & (F.col("gated_i") == F.col("rm_i"))
    up, down = (F.col("rm_ok") == 0) & (F.col("ungated_ok") == 1), (F.col("rm_ok") == 1) & (F.col("ungated_ok") == 0)
    return q.agg(
        F.count("*").alias("questions"), F.count_if(proposed).alias("proposal_switches"), F.count_if(accepted).alias("accepted_switches"), F.count_if(accepted & up).alias("accepted_corrections"),
        F.count_if(accepted & down).alias("accepted_damages"), F.count_if(accepted & ~up & ~down).alias("accepted_neutral"), F.count_if(rejected).alias("rejected_switches"),
        F.count_if(rejected & down).alias("prevented_damages"), F.count_if(rejected & up).alias("blocked_corrections"), F.count_if(rejected & ~up & ~down).alias("rejected_neutral"),
        F.sum(F.when(proposed, F.col("gated_ok") - F.col("ungated_ok")).otherwise(0)).cast("bigint").alias("net_saved"), F.avg(proposed.cast("int")).alias("proposal_switch_rate"),
    )


def transition(df: DataFrame, before: Column, after: Column, *by: str) -> DataFrame:
    """Counts of right to wrong, wrong to right and unchanged."""
    return df.groupBy(*by).agg(
        F.count_if((before == 1) & (after == 1)).alias("stay_right"), F.count_if((before == 0) & (after == 0)).alias("stay_wrong"),
        F.count_if((before == 1) & (after == 0)).alias("damaged"), F.count_if((before == 0) & (after == 1)).alias("corrected"),
    )


def judge_preference(pairs: DataFrame, raw: Column, new: Column, eps: float = 1e-6) -> DataFrame:
    """pairs: one row for each changed question, with raw_right and new_right. How a judge's scores prefer the new choice."""
    d = new - raw
    win, loss = d > eps, d < -eps
    changed = F.col("raw_right") != F.col("new_right")
    aligned = (win & (F.col("new_right") > F.col("raw_right"))) | (loss & (F.col("new_right") < F.col("raw_right")))
    return pairs.agg(F.count("*").alias("changed"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(~win & ~loss).alias("ties"), F.count_if(changed).alias("label_changes"), F.count_if(changed & aligned).alias("aligned"))


def judge_consensus(pairs: DataFrame, judges: list[tuple[Column, Column]], eps: float = 1e-6) -> DataFrame:
    """Sum of the judges' signs: which side most prefer, and whether they are unanimous."""
    signs = [F.when(n - r > eps, 1).when(n - r < -eps, -1).otherwise(0) for r, n in judges]
    v = sum(signs[1:], signs[0])
    x = pairs.withColumn("vote", v)
    return x.agg(F.count("*").alias("changed"), F.count_if(F.expr("vote > 0")).alias("prefer_new"), F.count_if(F.expr("vote < 0")).alias("prefer_raw"), F.count_if(F.expr("vote = 0")).alias("split"), F.count_if(F.abs("vote") == len(judges)).alias("unanimous"))
