"""Queries of trained heads and gates: candidates with chunk states come from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nets, training
from ..sources import scratch
from ..sources.views import table
from .base import query

H = 8


def state_candidates(s, d) -> DataFrame:
    """Every vector is a candidate: eight in a question, its slices are the states of 1 to 8 chunks, its last number the reward; it is
    right if its last state leads its first along two axes."""
    e = table(s, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    k = (F.col("vec_id") % 8).cast("int")
    states = F.transform(F.sequence(F.lit(0), k), lambda i: F.slice("v", i * H + 1, H))
    first, last = F.get("v", F.lit(0)) + F.get("v", F.lit(1)), F.get("v", k * H) + F.get("v", k * H + 1)
    return e.select(
        F.when(F.floor(F.col("vec_id") / 8) % 3 == 0, "b").otherwise("a").alias("dataset"), F.floor(F.col("vec_id") / 8).alias("question_uid"), k.alias("candidate_index"), states.alias("states"),
        F.get("v", F.lit(63)).alias("reward"), F.when(k == 0, F.col("vec_id") % 3 == 0).otherwise(last > first).cast("int").alias("label"), (10 + F.col("vec_id") % 90).alias("tokens"),
    )


def _parts(s, d) -> tuple[DataFrame, DataFrame, int]:
    """Training and pilot questions, written once, and a quarter of the longer data set: four steps an epoch at any size."""
    at = scratch.path(s, "questions")
    training.question_rows(state_candidates(s, d)).withColumn("pilot", F.pmod(F.xxhash64("question_uid"), F.lit(5)) == 0).write.parquet(at)
    rows = s.read.parquet(at)
    fit = rows.where("NOT pilot").drop("pilot")
    longest = max((r["count"] for r in fit.groupBy("dataset").count().collect()), default=1)  # a row for each data set
    return fit, rows.where("pilot").drop("pilot"), -(-longest // 4)


def _trained(s, d, head, loss, better, epochs: int = 2) -> tuple[training.Run, DataFrame]:
    fit, pilot, per_step = _parts(s, d)
    return training.train(fit, pilot, head, loss, scratch.path(s, "run"), per_step, better, epochs=epochs, rate=0.02), fit


def _history(s, run: training.Run, variant: str) -> DataFrame:
    names = ["epoch", "loss", "selected", "top1", "pair", "damage", "correction", "raw_top1", "raw_pair"]
    kinds = "epoch int, loss double, selected boolean, top1 double, pair double, damage double, correction double, raw_top1 double, raw_pair double"
    return s.createDataFrame([tuple(r[n] for n in names) for r in run.history], kinds).withColumn("variant", F.lit(variant))


@query("lrn04_joint_training")
def joint_training(s, d):
    """A record for each epoch of the trajectory head, trained on both data sets alike."""
    return _history(s, _trained(s, d, nets.Trajectory(H, 8, 4), nets.QuestionLoss(), training.banded)[0], "trajectory")


@query("lrn05_local_heads")
def local_heads(s, d):
    """The same for the head of pooled changes and end state, and for the bounded residual that keeps the reward."""
    a, _ = _trained(s, d, nets.LocalEndpoint(H, 8, 4, 8, 16, 8), nets.PairLoss(256), training.banded)
    b, _ = _trained(s, d, nets.BoundedResidual(H, 8, 4, 8), nets.PairLoss(256, 0.1), training.guarded)
    return _history(s, a, "endpoint").unionByName(_history(s, b, "residual"))


@query("lrn03_trajectory_scores")
def trajectory_scores(s, d):
    """Scores of all candidates of mixed questions by the trained trajectory head."""
    head = nets.Trajectory(H, 8, 4)
    run, fit = _trained(s, d, head, nets.QuestionLoss(), training.banded, 1)
    return training.scores(training.question_rows(state_candidates(s, d)), head, run.weights, training.scale_of(fit)).select("dataset", "question_uid", "candidate_index", "rm", "score")
