"""Arrays and sequences: vectors of candidates, differences and decays along an order, losses, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import best_first, question, cluster_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length, which counts as 1e-8 at least."""
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def differences(a: Column) -> Column:
    """Each element less the one before."""
    n = F.size(a)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x - y))


def tail_mean(a: Column, k: int = 8) -> Column:
    m = F.least(F.lit(k), F.size(a))
    return F.aggregate(F.slice(a, -k if k == 1 else F.greatest(F.size(a) - k, F.lit(0)) + 1, m), F.lit(0.0), lambda s, x: s + x) / m


def ragged(flat: Column, begin: Column, end: Column) -> Column:
    """The part of a flat array between two offsets from 0."""
    return F.slice(flat, begin + 1, end - begin)


def vector_cohesion(df: DataFrame) -> DataFrame:
    """For each cluster of unit vectors: length of the centroid, mean cosine of pairs (|sum|^2 - n) / (n (n - 1)), and 1 - cosine
    of its centroid and that of the question's other vectors. Sums by dimension, never pairs."""
    u = df.withColumn("cluster", cluster_key()).select("question_uid", "cluster", F.posexplode(unit(F.col("v"))).alias("i", "x"))
    own = u.groupBy("question_uid", "cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("question_uid", "i")
    rest = own.withColumn("o", F.sum("s").over(w) - F.col("s"))
    c = rest.groupBy("question_uid", "cluster").agg(F.max("n").alias("n"), F.sum(F.col("s") ** 2).alias("ss"), F.sum(F.col("o") ** 2).alias("oo"), F.sum(F.col("s") * F.col("o")).alias("so"))
    n = F.col("n")
    return c.select(
        "question_uid", "cluster", "n", (F.sqrt("ss") / n).alias("centroid_norm"), F.when(n > 1, (F.col("ss") - n) / (n * F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(1.0)).alias("pair_cosine"),
        F.when(F.col("oo") > 1e-16, 1 - F.col("so") / (F.sqrt("ss") * F.sqrt("oo"))).alias("separation"),
    )


def nll_features(df: DataFrame, mean: str, last: str) -> DataFrame:
    """For each cluster -mean, -least z of a mean negative log likelihood and -mean z of another."""
    from .clusters import with_z

    z = with_z(with_z(df, mean, "z_mean"), last, "z_last").withColumn("cluster", cluster_key())
    return z.groupBy("question_uid", "cluster").agg((-F.avg("z_mean")).alias("nll_mean"), (-F.min("z_mean")).alias("nll_best"), (-F.avg("z_last")).alias("nll_last"))


def decayed_change(df: DataFrame, x: str, gate: Column, gamma: float) -> DataFrame:
    """Sum of gamma^(T-2-t) g e / (sum of gamma^(T-2-t) g + 1e-6) over changes e of x along a question's candidates."""
    w = question().orderBy("candidate_index")
    e = df.withColumn("g", gate).select("question_uid", (F.lead(x).over(w) - F.col(x)).alias("e"), "g", (F.row_number().over(w) - 1).alias("t"), F.count("*").over(question()).alias("n"))
    k = F.pow(F.lit(gamma), (F.col("n") - 2 - F.col("t")).cast("double")) * F.col("g")
    return e.groupBy("question_uid").agg((F.coalesce(F.sum(F.when(F.col("e").isNotNull(), k * F.col("e"))), F.lit(0.0)) / (F.coalesce(F.sum(F.when(F.col("e").isNotNull(), k)), F.lit(0.0)) + 1e-6)).alias("reward"))


def transition_pool(df: DataFrame, weight: Column, x: Column, *by: str) -> DataFrame:
    """Weighted mean and sqrt(weighted variance + 1e-8)."""
    d = df.withColumns({"w": weight, "x": x}).groupBy(*by).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") ** 2).alias("sxx"))
    den = F.greatest(F.col("sw"), F.lit(1e-8))
    mean = F.col("sx") / den
    var = F.col("sxx") / den - 2 * mean * F.col("sx") / den + mean * mean * F.col("sw") / den
    return d.select(*by, mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0)) + 1e-8).alias("std"))


def support_entropy(cand: DataFrame) -> DataFrame:
    """Entropy of cluster shares over the logarithm of their number, and the lead of the largest share over the next."""
    c = cand.groupBy("question_uid", cluster_key().alias("cluster")).agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(question())).withColumn("r", F.row_number().over(question().orderBy(F.desc("n"), "cluster")))
    g = c.groupBy("question_uid").agg(F.count("*").alias("k"), (-F.sum(F.col("p") * F.ln(F.greatest("p", F.lit(1e-12))))).alias("h"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("p2"))
    return g.select("question_uid", F.when(F.col("k") > 1, F.col("h") / F.ln(F.greatest(F.col("k"), F.lit(2)))).otherwise(0.0).alias("entropy"), F.when(F.col("k") > 1, F.col("p1") - F.col("p2")).otherwise(1.0).alias("support_margin"))


def top_margin(df: DataFrame, x: str = "rm") -> DataFrame:
    t = df.withColumn("r", F.row_number().over(question().orderBy(F.desc(x), "candidate_index"))).where("r <= 2")
    return t.groupBy("question_uid").agg(F.max(F.when(F.col("r") == 1, F.col(x))).alias("top1"), F.max(F.when(F.col("r") == 2, F.col(x))).alias("top2")).withColumn("margin", F.col("top1") - F.col("top2"))


def max_of_others(df: DataFrame, x: str = "rm") -> DataFrame:
    """Largest x of a question's other candidates; its own if there is none."""
    a, b = F.first(x).over(question().orderBy(F.desc(x), "candidate_index")), F.row_number().over(question().orderBy(F.desc(x), "candidate_index"))
    second = F.nth_value(x, 2).over(question().orderBy(F.desc(x), "candidate_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select("question_uid", "candidate_index", a.alias("__a"), b.alias("__b"), second.alias("__c"), x).select("question_uid", "candidate_index", F.coalesce(F.when(F.col("__b") == 1, F.col("__c")).otherwise(F.col("__a")), F.col(x)).alias("max_other"))


def sigmoid(x: Column, clip: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def p_true(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def binomial(n: Column, k: int) -> Column:
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (n - k + i).cast("double") / i), F.lit(1.0), lambda a, b: a * b) if k else F.lit(1.0)


def ranking_losses(df: DataFrame, score: str = "score", tau: float = 1.0, tau_cal: float = 1.0) -> DataFrame:
    """Listwise, pairwise and Brier losses of each question that has both labels. The pairs are built within a question: a loss
    over pairs has no closed form; questions are small."""
    s = F.col(score) / tau
    c = df.withColumn("s", s)
    c = c.withColumns({"m": F.max("s").over(question()), "mp": F.max(F.when(F.col("label") == 1, F.col("s"))).over(question())})
    lists = c.groupBy("question_uid").agg((F.first("m") + F.ln(F.sum(F.exp(F.col("s") - F.col("m")))) - F.first("mp") - F.ln(F.sum(F.when(F.col("label") == 1, F.exp(F.col("s") - F.col("mp")))))).alias("listwise"))
    p, q = df.where("label = 1").select("question_uid", F.col(score).alias("p")), df.where("label = 0").select("question_uid", F.col(score).alias("q"))
    d = F.col("p") - F.col("q")
    pairs = p.join(q, "question_uid").groupBy("question_uid").agg(F.avg(softplus(-d / tau)).alias("bt"), F.avg((sigmoid(d / tau_cal) - 1) ** 2).alias("brier"))
    return lists.join(pairs, "question_uid")


def damage_losses(df: DataFrame, score: str = "score", margin: float = 0.1) -> DataFrame:
    """Terms that protect a right raw choice, correct a wrong one, and anchor the scores to the raw ones (smooth L1)."""
    w = best_first()
    c = df.withColumn("r", F.row_number().over(w))
    diff = F.abs(F.col(score) - F.col("rm"))
    g = c.groupBy("question_uid").agg(
        F.max(F.when(F.col("r") == 1, F.col("label"))).alias("ok"), F.max(F.when(F.col("r") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("label") == 0, F.col(score))).alias("neg"), F.max(F.when(F.col("label") == 1, F.col(score))).alias("pos"),
        (F.max(F.when(F.col("r") == 1, F.col("rm"))) - F.max(F.when(F.col("r") == 2, F.col("rm")))).alias("raw_margin"), F.avg(F.when(diff < 1, 0.5 * diff * diff).otherwise(diff - 0.5)).alias("smooth"),
    ).where(F.col("pos").isNotNull() & F.col("neg").isNotNull())
    right = F.col("ok") == 1
    return g.select(
        "question_uid", F.when(right, softplus(F.col("neg") - F.col("top") + margin)).otherwise(0.0).alias("protect"), F.when(right, F.lit(0.0)).otherwise(softplus(F.col("top") - F.col("pos") + margin)).alias("correct"),
        (F.when(right, 1 + sigmoid(F.col("raw_margin"))).otherwise(0.25) * F.col("smooth")).alias("anchor"),
    )
