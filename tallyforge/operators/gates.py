"""Gates: whether to trust a proposed switch. Features, guards, logistic models and cross-fitting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import sums
from .clusters import best_first, question
from .select import FEATURES


def switch_features(cand: DataFrame, seeds: list[str], alphas: list[str], beta: float, chunks: str, length: str) -> DataFrame:
    """21 features of each question's raw choice and proposal, the best by raw + beta (mean of seed scores - raw)."""
    c = cand.withColumns({f"d_{s}": F.col(s) - F.col("rm") for s in seeds})
    ds = [F.col(f"d_{s}") for s in seeds]
    k = len(ds)
    mean = sum(ds[1:], ds[0]) / k
    c = c.withColumn("md", mean)
    c = c.withColumn("sd", F.sqrt(sum((d - F.col("md")) ** 2 for d in ds) / k)).withColumn("blend", F.round(F.col("rm") + beta * F.col("md"), 9))
    order = {"r": best_first(), "p": question().orderBy(F.desc("blend"), "candidate_index")}
    order |= {f"t{i}": question().orderBy(F.desc(F.round(F.col("rm") + beta * ds[i], 9)), "candidate_index") for i in range(k)}
    c = c.withColumns({n: F.row_number().over(w) for n, w in order.items()})

    def at(place: str, n: int, x: Column | str) -> Column:
        return F.max(F.when(F.col(place) == n, F.col(x) if isinstance(x, str) else x))

    picks = {"raw_rm": at("r", 1, "rm"), "raw2_rm": at("r", 2, "rm"), "prop_rm": at("p", 1, "rm"), "raw_blend": at("r", 1, "blend"), "prop_blend": at("p", 1, "blend"), "raw_i": at("r", 1, "candidate_index"), "prop_i": at("p", 1, "candidate_index")}
    picks |= {f"rd{i}": at("r", 1, d) for i, d in enumerate(ds)} | {f"pd{i}": at("p", 1, d) for i, d in enumerate(ds)} | {f"ti{i}": at(f"t{i}", 1, "candidate_index") for i in range(k)}
    picks |= {f"ra{i}": at("r", 1, a) for i, a in enumerate(alphas)} | {f"pa{i}": at("p", 1, a) for i, a in enumerate(alphas)}
    picks |= {"raw_c": at("r", 1, chunks), "prop_c": at("p", 1, chunks), "raw_l": at("r", 1, length), "prop_l": at("p", 1, length), "raw_ok": at("r", 1, "label"), "prop_ok": at("p", 1, "label")}
    q = c.groupBy("question_uid").agg(F.count("*").alias("n"), F.stddev_pop("rm").alias("rm_sd"), F.avg("sd").alias("sd_mean"), F.stddev_pop("md").alias("md_sd"), *[v.alias(n) for n, v in picks.items()]).where("n > 1")

    def both(xs: list[Column]) -> tuple[Column, Column]:
        m = sum(xs[1:], xs[0]) / len(xs)
        return m, F.sqrt(F.greatest(sum((x - m) ** 2 for x in xs) / len(xs), F.lit(0.0)))

    gap, gap_sd = both([F.col(f"pd{i}") - F.col(f"rd{i}") for i in range(k)])
    ra, ra_sd = both([F.col(f"ra{i}") for i in range(len(alphas))])
    pa, pa_sd = both([F.col(f"pa{i}") for i in range(len(alphas))])
    agree = sum((F.col(f"ti{i}") == F.col("prop_i")).cast("int") for i in range(k)) / k
    moved = sum((F.col(f"ti{i}") != F.col("raw_i")).cast("int") for i in range(k)) / k
    features = {
        "raw_margin": F.col("raw_rm") - F.col("raw2_rm"), "raw_rm": F.col("raw_rm"), "prop_rm": F.col("prop_rm"), "rm_sd": F.col("rm_sd"), "log_n": F.log1p("n"), "proposed_margin": F.col("prop_blend") - F.col("raw_blend"),
        "gap_mean": gap, "gap_sd": gap_sd, "agreement": agree, "switch_rate": moved, "alpha_raw": ra, "alpha_raw_sd": ra_sd, "alpha_prop": pa, "alpha_prop_sd": pa_sd, "log_chunks": F.log1p("raw_c"),
        "log_chunks_gain": F.log1p("prop_c") - F.log1p("raw_c"), "log_length": F.log1p("raw_l"), "log_length_gain": F.log1p("prop_l") - F.log1p("raw_l"), "sd_mean": F.col("sd_mean"), "md_sd": F.col("md_sd"), "beta": F.lit(float(beta)),
    }
    return q.select("question_uid", *[v.alias(n) for n, v in features.items()], (F.col("raw_i") != F.col("prop_i")).alias("switch"), (F.col("prop_ok") - F.col("raw_ok")).alias("target"))


def ood_distance(df: DataFrame, fit: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Root mean square of (x - median) / (p90 - p10), clipped to 10, over columns that vary in fit (which gives the statistics)."""
    got = fit.agg(*[F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(c) for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns]).first()  # one row
    use = [c for c in columns if got[f"sd_{c}"] is not None and got[f"sd_{c}"] > 1e-7]
    z = [F.greatest(F.least((F.col(c) - got[c][1]) / ((got[c][2] - got[c][0]) or 1.0), F.lit(10.0)), F.lit(-10.0)) for c in use]
    return df.select(key, F.sqrt(sum((x * x for x in z), F.lit(0.0)) / max(len(z), 1)).alias("distance"))


def reliability_features(clus: DataFrame) -> DataFrame:
    """clus: question_uid, cluster, n, rm_max, learned (z scores rm_z, learned_z, hybrid), is_raw, is_proposal and a margin for each
    model (m0, m1, …) -> 15 features of the proposed switch."""
    models = sorted(c for c in clus.columns if c.startswith("m") and c[1:].isdigit())
    c = clus.withColumn("share", F.col("n") / F.sum("n").over(question()))

    def of(flag: str, x: str) -> Column:
        return F.max(F.when(F.col(flag), F.col(x)))

    def rest(flag: str, x: str) -> Column:
        return F.coalesce(F.max(F.when(~F.col(flag), F.col(x))), of(flag, x))

    g = c.groupBy("question_uid").agg(
        F.count("*").alias("k"), (-F.sum(F.col("share") * F.ln(F.greatest("share", F.lit(1e-12))))).alias("h"), F.max("share").alias("most"), F.sort_array(F.collect_list("share"), False).alias("shares"),
        (of("is_raw", "rm_z") - rest("is_raw", "rm_z")).alias("raw_lead"), (of("is_proposal", "hybrid") - of("is_raw", "hybrid")).alias("hybrid_gain"), (of("is_proposal", "hybrid") - rest("is_proposal", "hybrid")).alias("hybrid_lead"),
        (of("is_proposal", "learned_z") - of("is_raw", "learned_z")).alias("learned_gain"), (of("is_proposal", "rm_z") - of("is_raw", "rm_z")).alias("rm_gain"), of("is_proposal", "share").alias("p_share"), of("is_raw", "share").alias("r_share"),
        *[(of("is_proposal", m) - of("is_raw", m)).alias(m) for m in models],
    )
    ms = [F.col(m) for m in models] or [F.lit(0.0)]
    mean = sum(ms[1:], ms[0]) / len(ms)
    one = F.col("k") == 1
    return g.select(
        "question_uid", "raw_lead", "hybrid_gain", "hybrid_lead", "learned_gain", "rm_gain", "p_share", "r_share", (F.col("p_share") - F.col("r_share")).alias("share_gain"), "most",
        F.when(one, 1.0).otherwise(F.get("shares", F.lit(0)) - F.get("shares", F.lit(1))).alias("support_margin"), F.when(one, 0.0).otherwise(F.col("h") / F.ln(F.greatest(F.col("k"), F.lit(2)))).alias("entropy"),
        (F.col("r_share") == F.col("most")).cast("double").alias("raw_is_most"), (F.col("p_share") == F.col("most")).cast("double").alias("prop_is_most"), F.log1p("k").alias("log_k"), F.sqrt(F.greatest(sum((m - mean) ** 2 for m in ms) / len(ms), F.lit(0.0))).alias("model_spread"),
    )


#: A column whose deviation is below this share of its mean is constant but for rounding.
_FLAT = 1e-12


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, c: float = 0.25, steps: int = 60) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weighted logistic regression with an L2 penalty of 1 / (2 c) on all but the intercept, by Newton steps, on standardised
    columns. Of one class only: a constant probability with half a count added."""
    if not len(x):  # nothing to learn from: even odds
        return np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > _FLAT * (1 + np.abs(mean)), sd, 1.0)
    if len(np.unique(y)) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.zeros(x.shape[1]), float(np.log(p / (1 - p))), mean, sd
    a = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w, theta = np.ones(len(y)) if weight is None else weight, np.zeros(a.shape[1])
    penalty = np.append(np.full(x.shape[1], 1 / c), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        gradient = a.T @ (w * (p - y)) + penalty * theta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-12)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-10:
            break
    return theta[:-1], float(theta[-1]), mean, sd


def logistic(columns: list[str], model: tuple) -> Column:
    w, b, mean, sd = model
    z = sum((float(k) * (F.col(c) - float(m)) / float(s) for c, k, m, s in zip(columns, w, mean, sd, strict=True)), F.lit(float(b)))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


@dataclass
class _Moments:
    """Number, means and sums of squared differences from them, of columns; and the sum of each 0-1 target."""

    n: float
    mean: np.ndarray
    away: np.ndarray
    ones: np.ndarray

    def plus(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return _Moments(n, self.mean + gap * other.n / n, self.away + other.away + gap**2 * self.n * other.n / n, self.ones + other.ones)


def fit_gates(df: DataFrame, columns: list[str], targets: list[tuple[Column, Column]], fold: Column | None = None, folds: int = 0, c: float = 0.25, steps: int = 60) -> list[list[tuple]]:
    """Logistic models (as of ``fit_logistic``) of each (0-1 target, weight), over all rows of df, by Newton steps: for each fold the
    model of the rows outside it, and last the model of all rows. In a step every task adds up the gradients and Gram matrices of all
    models that aren't done, and the driver gets one sum of them: columns squared numbers for each model, whatever the number of
    rows. A row with a null in a column, target or weight takes no part."""
    spark, p, place = df.sparkSession, len(columns), scratch.path(df.sparkSession, "gate")
    lean = df.select(
        F.array(*[F.col(x).cast("double") for x in columns]).alias("x"), F.array(*[y.cast("double") for y, _ in targets]).alias("y"), F.array(*[w.cast("double") for _, w in targets]).alias("w"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
    )
    lean.where("fold IS NOT NULL AND NOT exists(x, a -> a IS NULL OR isnan(a)) AND NOT exists(y, a -> a IS NULL) AND NOT exists(w, a -> a IS NULL)").write.parquet(place)
    rows = spark.read.schema(lean.schema).parquet(place)
    at = [F.get("x", F.lit(i)) for i in range(p)]
    got = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(at)], *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(at)], *[F.sum(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(len(targets))]).collect()  # a row for each fold
    nothing = _Moments(0, np.zeros(p), np.zeros(p), np.zeros(len(targets)))
    own = {r.fold: _Moments(r.n, np.array([r[f"m{i}"] for i in range(p)]), r.n * np.array([r[f"v{i}"] for i in range(p)]), np.array([r[f"y{i}"] for i in range(len(targets))])) for r in got}
    wholes = [reduce(_Moments.plus, [own[f] for f in sorted(own) if f != k], nothing) for k in [*range(folds), None]]
    raw = [np.sqrt(m.away / max(m.n, 1)) for m in wholes]
    sds = [np.where(sd > _FLAT * (1 + np.abs(m.mean)), sd, 1.0) for sd, m in zip(raw, wholes, strict=True)]
    models = [(t, k) for t in range(len(targets)) for k in range(folds + 1)]
    theta: dict[tuple, np.ndarray] = {}
    fixed: dict[tuple, tuple] = {}
    for t, k in models:
        m, ones = wholes[k], wholes[k].ones[t]
        if not m.n:
            fixed[t, k] = np.zeros(p), 0.0, np.zeros(p), np.ones(p)
        elif ones in (0, m.n):
            q = (ones + 0.5) / (m.n + 1.0)
            fixed[t, k] = np.zeros(p), float(np.log(q / (1 - q))), m.mean, sds[k]
        else:
            theta[t, k] = np.zeros(p + 1)
    penalty = np.append(np.full(p, 1 / c), 0.0)
    running, size = sorted(theta), p + 1
    for _ in range(steps):
        if not running:
            break
        now = [(t, k, wholes[k].mean, sds[k], theta[t, k]) for t, k in running]

        def part(batches: Iterator[pa.RecordBatch], now: list[tuple] = now) -> np.ndarray:
            out = np.zeros((len(now), size * (size + 1)))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, w = (b.column(n).flatten().to_numpy().reshape(b.num_rows, -1) for n in ("x", "y", "w"))
                of = b.column("fold").to_numpy()
                for i, (t, k, mean, sd, th) in enumerate(now):
                    here = of != k if k < folds else np.ones(len(of), bool)
                    a = np.column_stack(((x[here] - mean) / sd, np.ones(here.sum())))
                    q = 1 / (1 + np.exp(-np.clip(a @ th, -40, 40)))
                    out[i, :size] += a.T @ (w[here, t] * (q - y[here, t]))
                    out[i, size:] += ((a * (w[here, t] * q * (1 - q))[:, None]).T @ a).ravel()
            return out.ravel()

        found = sums.vector_sum(rows, part, len(now) * size * (size + 1)).reshape(len(now), -1)
        going = []
        for (t, k), total in zip(running, found, strict=True):
            step = np.linalg.solve(total[size:].reshape(size, size) + np.diag(penalty + 1e-12), total[:size] + penalty * theta[t, k])
            theta[t, k] = theta[t, k] - step
            if np.abs(step).max() >= 1e-10:
                going.append((t, k))
        running = going
    done = fixed | {(t, k): (th[:-1], float(th[-1]), wholes[k].mean, sds[k]) for (t, k), th in theta.items()}
    return [[done[t, k] for k in range(folds + 1)] for t in range(len(targets))]


def _benefit_and_damage() -> list[tuple[Column, Column]]:
    """Targets 1 and -1 of proposed switches; a benefit weighs 3, a damage 8."""
    return [((F.col("target") == t).cast("int"), F.when(F.col("target") == t, w).otherwise(1.0)) for t, w in ((1, 3.0), (-1, 8.0))]


def fit_utility_gate(df: DataFrame, columns: list[str]) -> tuple[tuple, tuple]:
    """Models of benefit and damage among proposed switches."""
    benefit, damage = fit_gates(df.where("switch"), columns, _benefit_and_damage())
    return benefit[0], damage[0]


def utility(columns: list[str], gate: tuple[tuple, tuple], damage_cost: float = 3.0) -> Column:
    return F.when(F.col("switch"), logistic(columns, gate[0]) - damage_cost * logistic(columns, gate[1])).otherwise(F.lit(-1e9))


def crossfit_utility(df: DataFrame, columns: list[str], folds: int = 5, key: str = "question_uid") -> DataFrame:
    """Utility of each question from gates that were fitted without its fold."""
    f = df.withColumn("fold", F.pmod(F.xxhash64(F.lit("gate"), F.col(key)), F.lit(folds)).cast("int"))
    benefit, damage = fit_gates(f.where("switch"), columns, _benefit_and_damage(), F.col("fold"), folds)
    out = F.lit(None).cast("double")
    for k in range(folds):
        out = F.when(F.col("fold") == k, utility(columns, (benefit[k], damage[k]))).otherwise(out)
    return f.withColumn("utility", out)


def guarded(df: DataFrame, distance: Column, cutoff: float, agreement: Column, least: float) -> Column:
    """Utility, or -1e9 for a question far from the training ones or of low agreement."""
    return F.when((distance > cutoff) | (agreement + 1e-8 < least), F.lit(-1e9)).otherwise(df["utility"])


def model_margin(weights: list[float], features: list[str] = FEATURES) -> Column:
    return sum((F.col(c) * w for c, w in zip(features, weights, strict=True)), F.lit(0.0))
