"""Learned linear ranker of clusters, the search for its configuration, and order-dependent choices among few rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import metrics, resample
from .clusters import cluster_features, clusters, with_z
from .select import FEATURES, fused_scores, with_features

#: Cluster pairs that the ranker is fitted on, at most; eight weights need no more.
PAIRS = 200_000
#: Leading bits of a pair's hash by which pairs are counted first.
LEAD = 14


def feature_stats(features: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and deviation (1e-4 at least) of every feature over all clusters."""
    row = features.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.greatest(F.stddev_pop(c), F.lit(1e-4)).alias(f"s_{c}") for c in FEATURES]).first()
    return [row[f"m_{c}"] for c in FEATURES], [row[f"s_{c}"] for c in FEATURES]


def pair_features(cand: DataFrame) -> DataFrame:
    """Features of every cluster and whether it is mostly right, written once for all seeds, statistics and either side of the pairs."""
    f = cluster_features(cand).join(clusters(cand).select("question_uid", "cluster", (F.col("label_share") >= 0.5).alias("right")), ["question_uid", "cluster"])
    f.write.parquet(at := scratch.path(cand.sparkSession, "features"))
    return cand.sparkSession.read.schema(f.schema).parquet(at)


def first_pairs(pairs: DataFrame, h: Column, *ties: str) -> DataFrame:
    """The PAIRS first rows in the order of the hash h and ties. Counts by its leading bits say how far to look, so that a task gives out
    no more than are looked for: of an order with a limit each task gives out PAIRS, and the driver or one task takes them all."""
    lead = F.shiftright(h, 64 - LEAD)
    edge, before = None, 0
    for edge, n in sorted(tuple(x) for x in pairs.groupBy(lead.alias("lead")).count().collect()):  # 2 ** LEAD rows at most
        before += n
        if before >= PAIRS:
            break
    return pairs.where(lead <= F.lit(edge)).orderBy(h, *ties).limit(PAIRS)


def pair_differences(cand: DataFrame, seed: int, features: DataFrame | None = None) -> np.ndarray:
    """Standardised features of mostly right clusters less those of mostly wrong ones of the same question, for questions drawn
    with replacement (Poisson counts by hash); PAIRS pairs at most, the first in hash order. features: pair_features of cand."""
    f = pair_features(cand) if features is None else features
    mean, sd = feature_stats(f)
    u = F.pmod(F.xxhash64(F.lit(seed), "question_uid"), F.lit(1 << resample.BITS))
    times = reduce(lambda x, y: x + y, [(u >= step).cast("int") for step in resample.poisson_steps()])
    z = f.select("question_uid", "cluster", "right", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(FEATURES, mean, sd, strict=True)]).withColumn("times", times).where("times > 0")
    p, q = z.where("right").drop("right"), z.where("NOT right").drop("right", "times")
    q = q.toDF("question_uid", "other", *[f"o_{c}" for c in FEATURES])
    pairs = first_pairs(p.join(q, "question_uid"), F.xxhash64(F.lit(seed), "question_uid", "cluster", "other"), "question_uid", "cluster", "other")
    rows = pairs.select("times", *[(F.col(c) - F.col(f"o_{c}")).alias(c) for c in FEATURES]).toArrow()
    differences = np.stack([rows.column(c).to_numpy() for c in FEATURES], 1).astype(float)
    return np.repeat(differences, rows.column("times").to_numpy().astype(int), axis=0)


def ranker_models(cand: DataFrame, seeds: tuple[int, ...], regularization: float) -> list[list[float]]:
    """The ranker's weights for each seed."""
    f = pair_features(cand)
    return [fit_ranker(pair_differences(cand, k, f), regularization).tolist() for k in seeds]


def fit_ranker(differences: np.ndarray, regularization: float, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights from zero by Adam on mean softplus(-difference . w) + regularization x mean square of w."""
    w = np.zeros(differences.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -40, 40)))
        g = -(differences * p[:, None]).mean(0) + 2 * regularization * w / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _strict_shares(e: np.ndarray, label: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each question and column of e the share of right-wrong pairs that e puts in order; NaN without such pairs.
    Questions of one size are compared place by place, all at once; large ones by sorting."""
    end = np.concatenate((start[1:], [len(e)]))
    out = np.full((len(start), e.shape[1]), np.nan)
    for n in np.unique(end - start):
        own = np.flatnonzero(end - start == n)
        rows = start[own][:, None] + np.arange(n)
        right = label[rows] == 1
        pairs = right.sum(1) * (~right).sum(1)
        if n > 32:
            for k in np.flatnonzero(pairs):
                p, q = e[rows[k][right[k]]], np.sort(e[rows[k][~right[k]]], axis=0)
                out[own[k]] = [np.searchsorted(q[:, c], p[:, c]).sum() / pairs[k] for c in range(e.shape[1])]
            continue
        wins = np.zeros((len(own), e.shape[1]))
        for i in range(n):
            for j in range(n):
                some = np.flatnonzero(right[:, i] & ~right[:, j])
                wins[some] += e[rows[some, i]] > e[rows[some, j]]
        out[own[pairs > 0]] = wins[pairs > 0] / pairs[pairs > 0, None]
    return out


def _outcomes(t: pa.Table, weights: np.ndarray, betas: np.ndarray, thresholds: list[float]) -> list[np.ndarray]:
    """Sums over the questions of t, whole and sorted: for each threshold, rows of SUMS by configuration (model, beta)."""
    c = {x: t.column(x).to_numpy() for x in t.column_names}
    new = np.concatenate(([True], c["question_uid"][1:] != c["question_uid"][:-1]))
    start, of = np.flatnonzero(new), np.cumsum(new) - 1
    new_cluster = new | np.concatenate(([True], c["first_index"][1:] != c["first_index"][:-1]))
    at, cluster = np.flatnonzero(new_cluster), np.cumsum(new_cluster) - 1
    own, begin = of[at], np.searchsorted(of[at], np.arange(len(start)))
    learned = np.stack([c[x][at].astype(float) for x in FEATURES], 1) @ weights.T
    k = np.bincount(own)[:, None]
    away = learned - (np.add.reduceat(learned, begin) / k)[own]
    sd = np.sqrt(np.add.reduceat(away**2, begin) / k)[own]
    zl = np.where(sd < 1e-6, 0.0, away / np.maximum(sd, 1e-6))
    score = np.round(c["zr"][at][:, None, None] + betas * zl[:, :, None], 9).reshape(len(at), -1)
    raw = c["has_raw"][at][:, None] == 1
    top = np.maximum.reduceat(score, begin)
    lead = top - np.add.reduceat(np.where(raw, score, 0.0), begin)
    first = np.where(score == top[own], c["first_index"][at][:, None], np.iinfo(np.int64).max)
    leads = first == np.minimum.reduceat(first, begin)[own]
    raw_leads = np.logical_or.reduceat(leads & (score == top[own]) & raw, begin)
    rel, index, label = 1e-4 * c["rel"][:, None], c["candidate_index"].astype(np.int64), c["label"].astype(np.int64)
    chosen = c["place"] == 1
    raw_right, raw_index, found = label[chosen], index[chosen], []
    for cluster_score in (score, np.where(raw, top[own] + 1e-4, score)):  # as it is, and with the raw choice held on top
        e = np.round(cluster_score[cluster] + rel, 9)
        best = np.where(e == np.maximum.reduceat(e, start)[of], index[:, None], np.iinfo(np.int64).max)
        pick = np.minimum.reduceat(best, start)
        right = np.add.reduceat((index[:, None] == pick[of]) * label[:, None], start)
        found.append((right, pick != raw_index[:, None], _strict_shares(e, label, start)))
    out = []
    for x in thresholds:
        held = ~raw_leads & (lead <= x)
        right, switched, strict = (np.where(held, b, a) for a, b in zip(*found, strict=True))
        some = ~np.isnan(strict)
        sums = [np.full(right.shape[1], len(start)), right.sum(0), np.where(some, strict, 0).sum(0), some.sum(0), (raw_right[:, None] * (1 - right)).sum(0), np.full(right.shape[1], raw_right.sum()), switched.sum(0)]
        out.append(np.stack(sums).astype(float))
    return out


SUMS = ["questions", "right", "strict", "eligible", "damage", "raw_right", "switched"]


def grid(cand: DataFrame, models: dict[float, list[list[float]]], betas: list[float], thresholds: list[float]) -> DataFrame:
    """Ranking metrics of every configuration. Candidates are shuffled once, by question; all configurations of a question are
    columns of arrays there, and a task gives a row of sums for each."""
    regs = sorted(models)
    weights = np.array([np.mean(models[x], 0) for x in regs])
    rows = with_z(with_features(cand), "rm", "rel").select("question_uid", "candidate_index", F.col("label").cast("int").alias("label"), "first_index", "place", "has_raw", "rel", "zr", *[x for x in FEATURES if x != "has_raw"])
    rows = rows.sortWithinPartitions("question_uid", "first_index", "candidate_index")
    names = [(x, b, t) for t in thresholds for x in regs for b in betas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((len(thresholds), len(SUMS), len(regs) * len(betas))), []

        def add(parts: list[pa.RecordBatch]) -> None:
            if parts and (t := pa.Table.from_batches(parts)).num_rows:
                total[:] += _outcomes(t, weights, np.array(betas), thresholds)

        for batch in batches:
            q = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(q[1:] != q[:-1])[-1]) + 1 if len(q) > 1 and (q[1:] != q[:-1]).any() else 0
            if held and len(q) and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                add(held)
                held = []
            if cut:
                add([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        add(held)
        sums = total.transpose(1, 0, 2).reshape(len(SUMS), -1)
        yield pa.RecordBatch.from_pydict(dict(zip(("reg", "beta", "threshold"), (pa.array(map(float, x)) for x in zip(*names, strict=True)), strict=True)) | {c: pa.array(x) for c, x in zip(SUMS, sums, strict=True)})

    found = rows.mapInArrow(run, "reg double, beta double, threshold double, " + ", ".join(f"{c} double" for c in SUMS))
    g = found.groupBy("reg", "beta", "threshold").agg(*[F.sum(c).alias(c) for c in SUMS])
    return g.select(
        "reg", "beta", "threshold", (F.col("right") / F.col("questions")).alias("top1"), F.try_divide("strict", "eligible").alias("pair_macro_strict"),
        (F.col("damage") / F.greatest("raw_right", F.lit(1.0))).alias("damage_rate"), (F.col("switched") / F.col("questions")).alias("switch_rate"),
    )


def choose(grid_rows: DataFrame, limit: float = 0.03) -> DataFrame:
    """The row of damage within the limit (or of least damage) with most top-1, then most pairs in order, then least damage, then
    fewest switches."""
    least = grid_rows.agg(F.min("damage_rate").alias("least"))
    g = grid_rows.crossJoin(F.broadcast(least)).where((F.col("damage_rate") <= limit) | ((F.col("least") > limit) & (F.col("damage_rate") == F.col("least"))))
    order = [F.desc(F.round("top1", 9)), F.desc(F.round("pair_macro_strict", 9)), F.round("damage_rate", 9), F.round("switch_rate", 9), "reg", "beta", "threshold"]
    return g.withColumn("fallback", F.col("least") > limit).drop("least").orderBy(*order).limit(1)


def verify_choice(grid_rows: DataFrame, chosen: DataFrame, limit: float = 0.03) -> DataFrame:
    """Whether the frozen choice is what its own grid gives."""
    again = choose(grid_rows, limit).select("reg", "beta", "threshold")
    return chosen.select("reg", "beta", "threshold").exceptAll(again).agg((F.count("*") == 0).alias("verified"))


def better(new: dict, old: dict | None, band: float = 0.005) -> bool:
    """Top-1 decides outside a band around it, then the pair metric, then damage. The band isn't transitive, so rows are taken in
    their order."""
    if old is None or abs(new["top1"] - old["top1"]) > band:
        return old is None or new["top1"] > old["top1"]
    if new["pair"] != old["pair"]:
        return new["pair"] > old["pair"]
    return new["damage"] < old["damage"]


def tie_band_choice(rows: list[dict], band: float = 0.005) -> dict | None:
    best = None
    for x in rows:
        best = x if better(x, best, band) else best
    return best


def evaluate(cand: DataFrame, models: list[list[float]], beta: float, threshold: float) -> DataFrame:
    return metrics.ranking_metrics(metrics.question_outcomes(fused_scores(cand, models, beta, threshold).withColumn("score", F.round("score", 9))))


def guarded_layer(layers: DataFrame, least_gain: float = 0.0, most_loss: float = 0.01) -> DataFrame:
    """layers: layer, dataset, score, baseline. The layer of most mean gain whose gain is above least_gain and that loses no more
    than most_loss on any data set."""
    g = layers.groupBy("layer").agg(F.avg(F.col("score") - F.col("baseline")).alias("gain"), F.min(F.col("score") - F.col("baseline")).alias("worst"))
    return g.where((F.col("gain") > least_gain) & (F.col("worst") >= -most_loss)).orderBy(F.desc(F.round("gain", 9)), "layer").limit(1)
