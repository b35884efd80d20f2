"""Training of scoring heads over partitions, balanced by data set, epoch by epoch, so that a stopped run goes on.

Plan: candidates become one row for each question, once, in a table. For each epoch every data set's questions come in a new hash
order, shorter ones again and again until all are as long as the longest; equal stretches of these orders are the steps. The
epoch's table has a folder for each step, so that a step reads its own rows only. In a step each task gives the gradient of its
questions, and these are added up block by block (``sums``): the driver gets one gradient, whatever the number of tasks. Weights and the optimiser's moments are written after each epoch; a
run begins after the last epoch that is whole on disk, and with the same partitions gives the same weights as one that wasn't
stopped (with others, the same but for the order of floating-point sums).

Cases: questions without a right or without a wrong candidate teach nothing and are left out, as are candidates without a question,
label, reward or states. A null data set is one, named by the empty string. A loss that isn't finite is an error. All candidates of
a question are in one row: they are as many as were generated for it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import corpus, metrics, sums
from .nets import Batch, Params

@dataclass(frozen=True)
class Scale:
    """Means and deviations that standardise rewards and the logarithms of chunks and tokens, from the training candidates."""

    raw: tuple[float, float]
    chunks: tuple[float, float]
    tokens: tuple[float, float]


@dataclass
class Run:
    """weights: of the best epoch; history: a record for each epoch."""

    weights: Params
    history: list[dict] = field(default_factory=list)
    best: int = 0


def question_rows(candidates: DataFrame) -> DataFrame:
    """dataset, question_uid, candidate_index, states (array of arrays), reward, label (0 or 1), tokens -> a row for each question that
    has both labels, with its candidates in order."""
    c = candidates.withColumn("dataset", F.coalesce(F.col("dataset").cast("string"), F.lit(""))).where("question_uid IS NOT NULL AND label IN (0, 1) AND reward IS NOT NULL AND NOT isnan(reward) AND size(states) > 0")
    one = F.struct("candidate_index", F.col("states").cast("array<array<double>>").alias("states"), F.col("reward").cast("double").alias("reward"), F.col("label").cast("double").alias("label"), F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    rows = c.groupBy("dataset", "question_uid").agg(F.array_sort(F.collect_list(one)).alias("c"), F.max("label").alias("hi"), F.min("label").alias("lo")).where("hi = 1 AND lo = 0")
    return rows.select("dataset", "question_uid", *[F.col(f"c.{x}").alias(x) for x in ("candidate_index", "states", "reward", "label", "tokens")])


def scale_of(rows: DataFrame) -> Scale:
    """From rows of questions: every candidate counts once."""
    c = rows.select(F.explode(F.arrays_zip("states", "reward", "tokens")).alias("c")).select(F.col("c.reward").alias("raw"), F.log1p(F.size("c.states")).alias("chunks"), F.log1p("c.tokens").alias("tokens"))
    got = c.agg(*[f(x).alias(f"{n}_{x}") for x in ("raw", "chunks", "tokens") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    pair = lambda x: (float(got[f"mean_{x}"] or 0.0), max(float(got[f"sd_{x}"] or 0.0), 1e-6))
    return Scale(pair("raw"), pair("chunks"), pair("tokens"))


def _batch(b: pa.RecordBatch, scale: Scale) -> tuple[Batch, np.ndarray, np.ndarray]:
    """The candidates of rows of questions, their labels, and the first candidate of each question (and the end)."""
    lists = b.column("states")
    candidates = lists.flatten()  # one list of chunks for each candidate
    chunks = candidates.flatten()
    n = np.asarray(candidates.value_lengths())
    flat = chunks.flatten().to_numpy(zero_copy_only=False)
    states = flat.reshape(len(chunks), -1) if len(chunks) else np.zeros((0, 1))
    own = lambda x: b.column(x).flatten().to_numpy(zero_copy_only=False)
    fit = lambda x, s: (x - s[0]) / s[1]
    start = np.concatenate(([0], np.cumsum(n)))
    sizes = np.column_stack((fit(np.log1p(n), scale.chunks), fit(np.log1p(own("tokens")), scale.tokens)))
    return Batch(states, start, fit(own("reward"), scale.raw), sizes), own("label"), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))


def _seed(seed: int, question) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{question}".encode()).digest()[:8], "big")


def gradient(rows: DataFrame, head, weights: Params, loss, scale: Scale, seed: int = 0) -> tuple[float, Params]:
    """Mean loss of rows of questions and its gradient: one pass, one shuffle of blocks."""
    names = sorted(weights)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        p = shared.value
        total, size, grads = 0.0, 0.0, {k: np.zeros_like(v) for k, v in p.items()}
        for b in batches:
            for i in range(b.num_rows):  # a question at a time: one has all that its loss needs
                batch, label, _ = _batch(b.slice(i, 1), scale)
                score, back = head.forward(p, batch)
                own, weight, d = loss.of(score, label, batch.raw, _seed(seed, b.column("question_uid")[i].as_py()))
                total, size = total + own, size + weight
                for k, v in back(d).items():
                    grads[k] += v
        return np.concatenate([[total, size], *[grads[k].ravel() for k in names]])

    flat = sums.vector_sum(rows, part, 2 + sum(v.size for v in weights.values()))
    shared.unpersist()
    total, size, at, out = flat[0], max(flat[1], 1.0), 2, {}
    for k in names:
        out[k] = flat[at : at + weights[k].size].reshape(weights[k].shape) / size
        at += weights[k].size
    return float(total / size), out


def scores(rows: DataFrame, head, weights: Params, scale: Scale) -> DataFrame:
    """dataset, question_uid, candidate_index, label, rm (standardised reward) and score of every candidate of rows of questions."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                batch, label, start = _batch(b, scale)
                of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(start)))
                score, _ = head.forward(shared.value, batch)
                yield pa.RecordBatch.from_pydict({"dataset": b.column("dataset").take(of), "question_uid": b.column("question_uid").take(of), "candidate_index": b.column("candidate_index").flatten().cast(pa.int64()), "label": pa.array(label.astype(np.int32)), "rm": pa.array(batch.raw), "score": pa.array(score)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"dataset {kinds['dataset']}, question_uid {kinds['question_uid']}, candidate_index bigint, label int, rm double, score double")


def evaluate(rows: DataFrame, head, weights: Params, scale: Scale) -> dict[str, float]:
    """Means over data sets of top-1, pairs in order, damage and correction; raw_top1 and raw_pair: of the rewards alone."""
    s = scores(rows, head, weights, scale).withColumn("question_uid", F.struct("dataset", "question_uid"))
    out = metrics.question_outcomes(s).select("question_uid.dataset", "raw_right", "new_right", "strict", "half_tie", "switched")
    by = metrics.ranking_metrics(out, "dataset")
    raw = metrics.question_outcomes(s.withColumn("score", F.col("rm"))).select("question_uid.dataset", F.col("new_right").alias("r"), F.col("strict").alias("s")).groupBy("dataset").agg(F.avg("r").alias("raw_top1"), F.avg("s").alias("raw_pair"))
    got = by.join(raw, "dataset").agg(F.avg("top1").alias("top1"), F.avg("pair_macro_strict").alias("pair"), F.avg("damage_rate").alias("damage"), F.avg("correction_rate").alias("correction"), F.avg("raw_top1").alias("raw_top1"), F.avg("raw_pair").alias("raw_pair")).first()
    return {k: float(v) if v is not None else 0.0 for k, v in got.asDict().items()}


def banded(new: dict, best: dict | None, band: float = 0.005) -> bool:
    """Top-1 decides outside a band; inside it pairs in order, then damage."""
    if best is None or new["top1"] > best["top1"] + band:
        return True
    if abs(new["top1"] - best["top1"]) > band or new["pair"] < best["pair"] - 1e-10:
        return False
    return new["pair"] > best["pair"] + 1e-10 or new["damage"] < best["damage"]


def guarded(new: dict, best: dict | None, guard: float = 0.005) -> bool:
    """More pairs in order than the best so far (at first: than the rewards alone), with top-1 no further than guard below that of
    the rewards. Until then the untrained head stays."""
    return new["top1"] >= new["raw_top1"] - guard and new["pair"] > (new["raw_pair"] if best is None else best["pair"])


def epoch_steps(rows: DataFrame, sizes: dict, per_step: int, seed: int, epoch: int, tasks: int) -> DataFrame:
    """rows with step: per_step questions of each data set in each, in the epoch's own hash order, data sets repeated to the length of
    the longest (rounded up to whole steps); part: one of a step's tasks."""
    target = -(-max(sizes.values()) // per_step) * per_step
    rounds = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, -(-target // n))])[F.col("dataset")]
    length = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])[F.col("dataset")]
    keys = rows.select("dataset", "question_uid").withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    h = corpus.hashed(f"{seed}|{epoch}", F.col("round"), F.col("dataset"), F.col("question_uid"))
    at = corpus.in_hash_order(keys, ["dataset", "round"], "place", h, "question_uid").withColumn("place", F.col("round") * length + F.col("place") - 1).where(F.col("place") < target)
    steps = at.select("dataset", "question_uid", F.floor(F.col("place") / per_step).cast("int").alias("step"), (F.col("place") % tasks).cast("int").alias("part"))
    return rows.join(steps, ["dataset", "question_uid"])


def _adam(weights: Params, grads: Params, m: Params, v: Params, t: int, rate: float, decay: float, clip: float) -> None:
    """One step in place, with decoupled weight decay; a gradient longer than clip is shortened to it."""
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    short = min(1.0, clip / (norm + 1e-6))
    for k, g in grads.items():
        g = g * short
        m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        weights[k] = weights[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def save(spark: SparkSession, at: str, epoch: int, state: dict[str, Params], note: dict) -> None:
    """The state after an epoch, as a Parquet folder of its own; what a stopped run left there is replaced."""
    rows = [(kind, k, list(v.shape), v.ravel().tolist()) for kind, p in state.items() for k, v in p.items()]
    df = spark.createDataFrame(rows, "kind string, name string, shape array<int>, x array<double>").withColumn("note", F.lit(json.dumps(note, sort_keys=True)))
    df.coalesce(1).write.mode("overwrite").parquet(f"{at}/epoch-{epoch:05d}")


def load(spark: SparkSession, at: str) -> tuple[int, dict[str, Params], dict] | None:
    """The last epoch that was written to its end."""
    files, path = _files(spark, at)
    if not files.exists(path):
        return None
    jvm = spark.sparkContext._jvm
    done = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().startswith("epoch-") and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if not done:
        return None
    state: dict[str, Params] = {}
    for r in (got := spark.read.parquet(f"{at}/{done[-1]}").collect()):  # the weights
        state.setdefault(r.kind, {})[r.name] = np.array(r.x).reshape(r.shape)
    return int(done[-1].removeprefix("epoch-")), state, json.loads(got[0].note)


def train(rows: DataFrame, pilot: DataFrame, head, loss, at: str, per_step: int, better=banded, epochs: int = 30, patience: int = 5, rate: float = 1e-3, decay: float = 1e-4, clip: float = 1.0, seed: int = 1, tasks: int = 8) -> Run:
    """Weights of head fitted to rows (of ``question_rows``, written somewhere), chosen on pilot. at: a folder for the run's epochs; a
    run with other settings there is an error. tasks: how many read a step."""
    spark = rows.sparkSession
    sizes = {r["dataset"]: int(r["count"]) for r in rows.groupBy("dataset").count().collect()}  # a row for each data set
    if not sizes:
        raise ValueError("no question has both a right and a wrong candidate")
    scale = scale_of(rows)
    settings = {"head": [type(head).__name__, asdict(head)], "loss": [type(loss).__name__, asdict(loss)], "per_step": per_step, "rate": rate, "decay": decay, "clip": clip, "seed": seed, "scale": asdict(scale), "sizes": {str(k): n for k, n in sorted(sizes.items(), key=str)}, "better": better.__name__, "patience": patience}
    settings = json.loads(json.dumps(settings))
    weights = head.init(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in weights.items()}, {k: np.zeros_like(x) for k, x in weights.items()}, 0
    run, first, chosen, waited = Run({k: x.copy() for k, x in weights.items()}), 1, None, 0
    if (found := load(spark, at)) is not None:
        epoch, state, note = found
        if note["settings"] != settings:
            raise ValueError(f"{at} holds a run with other settings")
        weights, m, v, t, first, chosen, waited = state["weights"], state["m"], state["v"], note["t"], epoch + 1, note["chosen"], note["waited"]
        run = Run(state["best"], note["history"], note["best"])
    for epoch in range(first, epochs + 1):
        if waited >= patience:
            break
        place = scratch.path(spark, "epoch")
        steps = epoch_steps(rows, sizes, per_step, seed, epoch, tasks)
        steps.repartition(max(tasks, 1), "step", "part").sortWithinPartitions("step", "dataset", "question_uid").write.partitionBy("step").parquet(place)
        kept, losses = spark.read.parquet(place), []
        for step in range(-(-max(sizes.values()) // per_step)):
            value, grads = gradient(kept.where(F.col("step") == step), head, weights, loss, scale, seed)
            if not np.isfinite(value) or not all(np.isfinite(g).all() for g in grads.values()):
                raise ValueError(f"loss of epoch {epoch}, step {step} isn't finite")
            t += 1
            _adam(weights, grads, m, v, t, rate, decay, clip)
            losses.append(value)
        files, path = _files(spark, place)
        files.delete(path, True)
        found_ = evaluate(pilot, head, weights, scale)
        chosen_now = better(found_, chosen)
        if chosen_now:
            chosen, waited = found_, 0
            run.weights, run.best = {k: x.copy() for k, x in weights.items()}, epoch
        else:
            waited += 1
        run.history.append({"epoch": epoch, "loss": float(np.mean(losses)), "selected": chosen_now} | found_)
        save(spark, at, epoch, {"weights": weights, "m": m, "v": v, "best": run.weights}, {"settings": settings, "t": t, "chosen": chosen, "waited": waited, "history": run.history, "best": run.best})
    return run
