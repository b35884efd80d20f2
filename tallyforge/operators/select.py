"""Selection operators: each maps candidates to one chosen candidate, or to a score for every candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .clusters import best_first, canonical_solution, cluster_key, clusters, question, raw_choice, with_robust_z, with_z


def representative(cand: DataFrame, chosen: DataFrame) -> DataFrame:
    """The best candidate of the chosen cluster (question_uid, cluster) of each question."""
    own = Window.partitionBy("question_uid", "cluster").orderBy(F.desc_nulls_last("rm"), "candidate_index")
    return cand.withColumn("cluster", cluster_key()).join(chosen.select("question_uid", "cluster"), ["question_uid", "cluster"]).withColumn("r", F.row_number().over(own)).where("r = 1").select("question_uid", "candidate_index", "answer", "rm", "label")


def first_cluster(clus: DataFrame, *order) -> DataFrame:
    return clus.withColumn("r", F.row_number().over(question().orderBy(*order))).where("r = 1").drop("r")


def majority_unique(cand: DataFrame) -> DataFrame:
    """Most distinct solutions; ties by best score, then by first place."""
    return representative(cand, first_cluster(clusters(cand), F.desc("unique_solutions"), F.desc("rm_max"), "first_index"))


def majority_count(cand: DataFrame) -> DataFrame:
    """Most candidates; ties by best score, then by first place."""
    return representative(cand, first_cluster(clusters(cand), F.desc("n"), F.desc("rm_max"), "first_index"))


def majority_none_on_tie(cand: DataFrame) -> DataFrame:
    """Each question's majority if one cluster alone is largest; else no choice, and whether any tied cluster has a right one."""
    own = cand.withColumn("cluster", cluster_key()).groupBy("question_uid", "cluster").agg(F.count("*").alias("n"), F.max("label").alias("any_right"), F.max_by("label", F.struct("rm", -F.col("candidate_index"))).alias("best_label"))
    tied = own.withColumn("r", F.rank().over(question().orderBy(F.desc("n")))).where("r = 1")
    return tied.groupBy("question_uid").agg((F.count("*") > 1).alias("tie"), F.count("*").alias("k"), F.max("any_right").alias("any_right"), F.max("best_label").alias("best_label")).select(
        "question_uid", "tie", F.when(F.col("tie"), 0).otherwise(F.col("best_label")).alias("correct"), F.when(F.col("tie"), F.col("any_right")).otherwise(F.col("best_label")).alias("optimistic_correct")
    )


def majority_earliest(cand: DataFrame) -> DataFrame:
    """Most candidates among answered ones; ties by earliest appearance."""
    return first_cluster(clusters(cand.where(F.col("answer").isNotNull())), F.desc("n"), "first_index").select("question_uid", "answer", "n", "first_index")


def masses(cand: DataFrame, tau: float) -> DataFrame:
    """Log-sum-exp of score / tau in each cluster."""
    x = F.col("rm") / tau
    top = F.max(x).over(Window.partitionBy("question_uid", "cluster"))
    return cand.withColumn("cluster", cluster_key()).withColumn("top", top).groupBy("question_uid", "cluster").agg(
        (F.first("top") + F.ln(F.sum(F.exp(x - F.col("top"))))).alias("mass"), F.max("rm").alias("rm_max"), F.min("candidate_index").alias("first_index")
    )


def weighted_grid(cand: DataFrame, taus: list[float], thresholds: list[float]) -> DataFrame:
    """Every (tau, threshold): top-1, and the shares of right raw choices that are lost (damage), of wrong ones that are mended
    (correction) and of questions with another choice (switch). Masses are made once for each tau; a threshold only says whether the
    raw choice stays. One shuffle, by question."""
    c = cand.withColumn("cluster", cluster_key()).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    of = Window.partitionBy("question_uid", "tau")
    own = Window.partitionBy("question_uid", "tau", "cluster")
    best = [F.desc_nulls_last("rm"), F.col("candidate_index")]
    c = c.withColumns({"top": F.max(F.col("rm") / F.col("tau")).over(own), "k": F.row_number().over(own.orderBy(*best)), "a": F.row_number().over(of.orderBy(*best))})
    mass = F.round(F.first("top") + F.ln(F.sum(F.exp(F.col("rm") / F.col("tau") - F.col("top")))), 9)
    m = c.groupBy("question_uid", "tau", "cluster").agg(mass.alias("mass"), F.min("candidate_index").alias("first_index"), F.max(F.when(F.col("k") == 1, F.col("label"))).alias("label"), F.max((F.col("a") == 1).cast("int")).alias("raw"))
    at_raw = lambda x: F.max(F.when(F.col("raw") == 1, F.col(x))).over(of)
    m = m.withColumns({"r": F.row_number().over(of.orderBy(F.desc("mass"), "first_index")), "raw_mass": at_raw("mass"), "raw_right": at_raw("label")}).where("r = 1")
    m = m.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("switched", (F.col("raw") == 0) & (F.col("mass") - F.col("raw_mass") > F.col("threshold")))
    right, was = F.when(F.col("switched"), F.col("label")).otherwise(F.col("raw_right")), F.col("raw_right")
    rate = lambda x, n: F.sum(x) / F.greatest(F.sum(n), F.lit(1))
    return m.groupBy("tau", "threshold").agg(F.avg(right).alias("top1"), rate(was * (1 - right), was).alias("damage_rate"), rate((1 - was) * right, 1 - was).alias("correction_rate"), F.avg(F.col("switched").cast("int")).alias("switch_rate"))


def within_band(rows: DataFrame, band: float = 0.005) -> DataFrame:
    """Of the rows (tau, threshold) whose top-1 is within band of the best, the one of least damage, then most top-1, then fewest
    switches."""
    top = rows.agg(F.max(F.round("top1", 9)).alias("best"))
    order = [F.round("damage_rate", 9), F.desc(F.round("top1", 9)), F.round("switch_rate", 9), F.col("tau"), F.col("threshold")]
    return rows.crossJoin(F.broadcast(top)).where(F.round("top1", 9) >= F.col("best") - band).drop("best").orderBy(*order).limit(1)


def weighted_vote(cand: DataFrame, tau: float, threshold: float) -> DataFrame:
    """The cluster of largest mass, unless its lead over the raw choice's cluster is at most threshold."""
    m = masses(cand, tau)
    best = first_cluster(m, F.desc("mass"), "first_index").select("question_uid", F.col("cluster").alias("best"), F.col("mass").alias("best_mass"))
    raw = raw_choice(cand).select("question_uid", cluster_key().alias("cluster")).join(m, ["question_uid", "cluster"]).select("question_uid", F.col("cluster").alias("raw"), F.col("mass").alias("raw_mass"))
    keep = (F.col("best") != F.col("raw")) & (F.col("best_mass") - F.col("raw_mass") <= threshold)
    return representative(cand, best.join(raw, "question_uid").select("question_uid", F.when(keep, F.col("raw")).otherwise(F.col("best")).alias("cluster")))


def weighted_vote_tied(cand: DataFrame, tau: float = 4.0) -> DataFrame:
    """Largest mass; ties by best score, then by first place."""
    return representative(cand, first_cluster(masses(cand, tau), F.desc("mass"), F.desc("rm_max"), "first_index"))


def confidence_vote(cand: DataFrame, confidence: Column, temperature: float) -> DataFrame:
    """Largest sum of exp((confidence - largest) / temperature); ties by best score."""
    c = cand.withColumn("conf", confidence)
    weight = F.exp((F.col("conf") - F.max("conf").over(question())) / temperature)
    m = c.withColumn("w", weight).withColumn("cluster", cluster_key()).groupBy("question_uid", "cluster").agg(F.sum("w").alias("mass"), F.max("rm").alias("rm_max"), F.min("candidate_index").alias("first_index"))
    return representative(cand, first_cluster(m, F.desc(F.round("mass", 9)), F.desc("rm_max"), "first_index"))


def max_confidence(cand: DataFrame, confidence: Column) -> DataFrame:
    return cand.withColumn("conf", confidence).withColumn("r", F.row_number().over(question().orderBy(F.desc("conf"), "candidate_index"))).where("r = 1").select("question_uid", "candidate_index", "label")


def expand(cand: DataFrame, scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Candidate scores from cluster scores (question_uid, cluster, cluster_score, first_index), behind a fixed gate: if the best
    cluster's lead over the raw choice's is at most threshold, the raw one is set just above all. Within a cluster the order is
    that of z(rm)."""
    raw = raw_choice(cand).select("question_uid", cluster_key().alias("raw"))
    s = scores.join(raw, "question_uid")
    w = question()
    s = s.withColumns({"top": F.max("cluster_score").over(w), "raw_score": F.max(F.when(F.col("cluster") == F.col("raw"), F.col("cluster_score"))).over(w), "place": F.row_number().over(w.orderBy(F.desc("cluster_score"), "first_index"))})
    s = s.withColumn("proposal_is_raw", F.max(((F.col("place") == 1) & (F.col("cluster") == F.col("raw"))).cast("int")).over(w) == 1)
    gated = ~F.col("proposal_is_raw") & (F.col("top") - F.col("raw_score") <= threshold) & (F.col("cluster") == F.col("raw"))
    s = s.select("question_uid", "cluster", F.when(gated, F.col("top") + 1e-4).otherwise(F.col("cluster_score")).alias("gated_score"))
    c = with_z(cand, "rm", "rel").withColumn("cluster", cluster_key()).join(s, ["question_uid", "cluster"])
    return c.withColumn("score", F.col("gated_score") + 1e-4 * F.col("rel")).drop("gated_score", "rel", "cluster")


def by_cluster() -> WindowSpec:
    return Window.partitionBy("question_uid", "cluster")


def in_clusters(cand: DataFrame) -> DataFrame:
    """cand with what its cluster has, on every row: all windows begin with the question, so one shuffle serves what follows."""
    c = cand.withColumn("cluster", cluster_key()).withColumns({"place": F.row_number().over(best_first()), "first_index": F.min("candidate_index").over(by_cluster()), "rm_max": F.max("rm").over(by_cluster())})
    return c.withColumns({"has_raw": F.max((F.col("place") == 1).cast("int")).over(by_cluster()), "one": (F.col("candidate_index") == F.col("first_index")).cast("int")})


def with_cluster_z(c: DataFrame, x: str, out: str) -> DataFrame:
    """z of a value of clusters among the question's clusters, each counted once."""
    w = question()
    c = c.withColumns({"__k": F.sum("one").over(w), "__m": F.sum(F.col(x) * F.col("one")).over(w) / F.sum("one").over(w)})
    c = c.withColumn("__sd", F.sqrt(F.sum((F.col(x) - F.col("__m")) ** 2 * F.col("one")).over(w) / F.col("__k")))
    return c.withColumn(out, F.when(F.col("__sd") < 1e-6, F.lit(0.0)).otherwise((F.col(x) - F.col("__m")) / F.when(F.col("__sd") >= 1e-6, F.col("__sd")))).drop("__k", "__m", "__sd")


def gated(c: DataFrame, threshold: float, columns: list[str]) -> DataFrame:
    """As expand, for rows that carry cluster_score themselves."""
    w = question()
    c = c.withColumns({"top": F.max("cluster_score").over(w), "raw_score": F.max(F.when(F.col("has_raw") == 1, F.col("cluster_score"))).over(w), "raw_leads": F.first("has_raw").over(w.orderBy(F.desc("cluster_score"), "first_index"))})
    held = (F.col("raw_leads") == 0) & (F.col("top") - F.col("raw_score") <= threshold) & (F.col("has_raw") == 1)
    c = with_z(c, "rm", "rel").withColumn("score", F.when(held, F.col("top") + 1e-4).otherwise(F.col("cluster_score")) + 1e-4 * F.col("rel"))
    return c.select(*columns, "score")


def majority_scores(cand: DataFrame) -> DataFrame:
    """z(log1p distinct solutions) + 1e-4 z(best score) for each cluster, gated at 0 and expanded."""
    c = in_clusters(cand.withColumn("__s", canonical_solution())).withColumn("u", F.log1p(F.size(F.collect_set("__s").over(by_cluster()))))
    c = with_cluster_z(with_cluster_z(c, "u", "zu"), "rm_max", "zr")
    return gated(c.withColumn("cluster_score", F.col("zu") + 1e-4 * F.col("zr")), 0.0, cand.columns)


def majority_scores_counted(cand: DataFrame) -> DataFrame:
    """size + 1e-4 z(best score) + 1e-6 z(score)."""
    c = with_z(clusters(cand), "rm_max", "zr").select("question_uid", "cluster", (F.col("n") + 1e-4 * F.col("zr")).alias("base"))
    return with_z(cand, "rm", "rel").withColumn("cluster", cluster_key()).join(c, ["question_uid", "cluster"]).withColumn("score", F.col("base") + 1e-6 * F.col("rel")).drop("base", "rel", "cluster")


def weighted_scores(cand: DataFrame, tau: float = 4.0) -> DataFrame:
    c = in_clusters(cand)
    top = F.col("rm_max") / tau
    return gated(c.withColumn("cluster_score", top + F.ln(F.sum(F.exp(F.col("rm") / tau - top)).over(by_cluster()))), 0.0, cand.columns)


FEATURES = ["log_size", "share", "log_unique", "z_max", "z_mean", "z_lme", "z_std", "has_raw"]


def linear_scores(features: DataFrame, models: list[list[float]]) -> DataFrame:
    """Mean over models of the weighted sum of the features: one score for each cluster."""
    mean = [sum(m[i] for m in models) / len(models) for i in range(len(FEATURES))]
    total = sum((F.col(c) * w for c, w in zip(FEATURES, mean, strict=True)), F.lit(0.0))
    return features.withColumn("learned", total)


def with_features(cand: DataFrame) -> DataFrame:
    """cand with FEATURES of its cluster and zr (z of the cluster's best score) on every row."""
    w = by_cluster()
    c = with_robust_z(in_clusters(cand.withColumn("__s", canonical_solution())))
    c = c.withColumn("z_max", F.max("z").over(w)).withColumns({
        "log_size": F.log1p(F.count("*").over(w)), "share": F.count("*").over(w) / F.count("*").over(question()), "log_unique": F.log1p(F.size(F.collect_set("__s").over(w))),
        "z_mean": F.avg("z").over(w), "z_lme": F.col("z_max") + F.ln(F.avg(F.exp(F.col("z") - F.col("z_max"))).over(w)), "z_std": F.stddev_pop("z").over(w),
    })
    return with_cluster_z(c, "rm_max", "zr")


def fused_scores(cand: DataFrame, models: list[list[float]], beta: float, threshold: float) -> DataFrame:
    """z(best score) + beta z(learned score) for each cluster, gated and expanded."""
    c = with_cluster_z(linear_scores(with_features(cand), models), "learned", "zl")
    return gated(c.withColumn("cluster_score", F.col("zr") + beta * F.col("zl")), threshold, cand.columns)


def residual_blend(raw: Column, learned: list[Column], beta: float, median: bool = False) -> Column:
    """raw + beta (learned - raw), learned being the mean or median of several."""
    if median:
        joined = F.array_sort(F.array(*learned))
        n = len(learned)
        mid = (F.get(joined, F.lit((n - 1) // 2)) + F.get(joined, F.lit(n // 2))) / 2
    else:
        mid = sum(learned[1:], learned[0]) / len(learned)
    return raw + beta * (mid - raw)


def bounded_residual(raw: Column, local: Column, cap: float) -> Column:
    return raw + cap * F.tanh(local)


def trust_region(cand: DataFrame, gap_columns: list[str], beta: float, kappa: float) -> DataFrame:
    """Switch from the raw choice to the candidate of largest beta (mean gap - kappa deviation of gaps) - raw margin, if that is
    above 0. A gap is a seed's score less its score of the raw choice."""
    c = cand.withColumn("r", F.row_number().over(best_first()))
    raw = {f"__{g}": F.max(F.when(F.col("r") == 1, F.col(g))).over(question()) for g in gap_columns}
    c = c.withColumns({**raw, "raw_rm": F.max(F.when(F.col("r") == 1, F.col("rm"))).over(question()), "raw_index": F.max(F.when(F.col("r") == 1, F.col("candidate_index"))).over(question())})
    gaps = [F.col(g) - F.col(f"__{g}") for g in gap_columns]
    n = len(gaps)
    mean = sum(gaps[1:], gaps[0]) / n
    var = sum((g - mean) * (g - mean) for g in gaps) / n
    evidence = beta * (mean - kappa * F.sqrt(var)) - (F.col("raw_rm") - F.col("rm"))
    best = c.where("r > 1").withColumn("evidence", F.round(evidence, 9)).withColumn("k", F.row_number().over(question().orderBy(F.desc("evidence"), "candidate_index"))).where("k = 1")
    return best.select("question_uid", "raw_index", F.col("candidate_index").alias("challenger"), "evidence", F.when(F.col("evidence") > 0, F.col("candidate_index")).otherwise(F.col("raw_index")).alias("choice"))
