"""Contracts around models: batched scoring that resumes, generation with recovery, token statistics, scoring heads and probes.

The models themselves are callables given by the caller; nothing here needs a GPU. What comes out are columns of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import hash_edges
from .learn import fit_ranker
from .metrics import pair_counts


def in_halves(score: Callable[[list[str]], list[float]], texts: list[str]) -> list[float]:
    """Scores of a batch; one that is too large for the model's memory is scored in halves."""
    try:
        return list(score(texts))
    except MemoryError:
        if len(texts) == 1:
            raise
        mid = len(texts) // 2
        return in_halves(score, texts[:mid]) + in_halves(score, texts[mid:])


def score_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[float]]], batch: int = 32, out: str = "score") -> DataFrame:
    """df with a score. make() gives a task its model; batches are of like length, since partitions are sorted by it. With
    ``sinks.resume`` only rows without a score are scored. A score that isn't finite is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts, got = part[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                got += in_halves(model, texts[i : i + batch])
            if len(got) != len(part) or not np.isfinite(got).all():
                raise ValueError(f"{len(got)} scores for {len(part)} texts, or some aren't finite")
            yield part.assign(**{out: np.array(got, float)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.sortWithinPartitions(F.length(F.coalesce(F.col(text), F.lit("")))).mapInPandas(run, f"{schema}, `{out}` double")


def generate(questions: DataFrame, make: Callable[[], Callable[[str, int], str]], k: int, seed: int = 1) -> DataFrame:
    """k candidates of each question (question_uid, problem): a seed for each, so that any part can be made again by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            yield part.assign(solution_text=[model(p, s) for p, s in zip(part["problem"], part["seed"], strict=True)])

    rows = questions.select("question_uid", "problem", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("candidate_index"))
    rows = rows.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "question_uid", "candidate_index"), F.lit(2**31 - 1)))
    kind = questions.schema["question_uid"].dataType.simpleString()
    return rows.mapInPandas(run, f"question_uid {kind}, problem string, candidate_index int, seed bigint, solution_text string")


def recover(candidates: DataFrame, answer: Column, make: Callable[[], Callable[[str, int], str]]) -> DataFrame:
    """Candidates without an answer are generated once more (another seed); the first text stays beside the new one. The new text
    counts only if it has an answer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            yield part.assign(again=[model(p, s + 1) if bad else None for p, s, bad in zip(part["problem"], part["seed"], part["bad"], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    tried = candidates.withColumn("bad", answer.isNull()).mapInPandas(run, f"{schema}, bad boolean, again string")
    first = tried.withColumnRenamed("solution_text", "primary_solution_text").withColumn("solution_text", F.coalesce("again", "primary_solution_text"))
    won = F.col("bad") & answer.isNotNull()
    return first.withColumn("won", won).select(
        *[c for c in candidates.columns if c != "solution_text"], F.when(F.col("won"), F.col("again")).otherwise(F.col("primary_solution_text")).alias("solution_text"), "primary_solution_text", F.when(F.col("won"), "recovery").otherwise("primary").alias("stage"),
    )


def nll_stats(nll: Column) -> Column:
    """Mean, 90th percentile (linear), largest, mean of the last eight, and population deviation of token likelihoods."""
    n = F.size(nll)
    s = F.array_sort(nll)
    mean = F.aggregate(nll, F.lit(0.0), lambda a, x: a + x) / n
    at = 0.9 * (n - 1)
    lo = F.floor(at).cast("int")
    p90 = F.get(s, lo) + (at - lo) * (F.get(s, F.least(lo + 1, n - 1)) - F.get(s, lo))
    last = F.slice(nll, F.greatest(n - 7, F.lit(1)), F.least(n, F.lit(8)))
    sq = F.aggregate(nll, F.lit(0.0), lambda a, x: a + x * x) / n
    return F.struct(
        mean.alias("mean"), p90.alias("p90"), F.array_max(nll).alias("most"), (F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)).alias("last8"), F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias("sd")
    )


def gelu(x: np.ndarray) -> np.ndarray:
    from math import erf

    return 0.5 * x * (1 + np.vectorize(erf)(x / np.sqrt(2)))


def expit(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class TrajectoryHead:
    """Mixes a reward with the evidence gained along a solution's chunk states. Weights come from training elsewhere."""

    probe: np.ndarray  # (h,)
    probe_bias: float
    gate: tuple[np.ndarray, np.ndarray, np.ndarray, float]  # (g, 2h + 1), (g,), (g,), scalar
    alpha: tuple[np.ndarray, np.ndarray, np.ndarray, float]  # (a, 5), (a,), (a,), scalar
    reward: tuple[float, float]
    log_t: tuple[float, float]
    log_l: tuple[float, float]
    gamma: float = 0.9

    @staticmethod
    def _mlp(net: tuple, x: np.ndarray) -> np.ndarray:
        a, b, c, d = net
        return gelu(x @ a.T + b) @ c + d

    def score(self, states: np.ndarray, reward: float, tokens: int) -> dict[str, float]:
        scaled = lambda x, s: (x - s[0]) / max(s[1], 1e-6)
        raw = scaled(reward, self.reward)
        h = (states - states.mean(1, keepdims=True)) / np.sqrt(states.var(1, keepdims=True) + 1e-5)
        z = h @ self.probe + self.probe_bias
        if len(z) < 2:  # no change to learn from: the reward as it is
            return {"score": raw, "trajectory": 0.0, "alpha": 1.0}
        gained = np.diff(z)
        weight = self.gamma ** np.arange(len(gained) - 1, -1, -1) * expit(self._mlp(self.gate, np.column_stack((h[:-1], h[1:], gained))))
        trajectory = float((weight * gained).sum() / (weight.sum() + 1e-6))
        alpha = float(expit(self._mlp(self.alpha, np.array([raw, z[-1], trajectory, scaled(np.log1p(len(z)), self.log_t), scaled(np.log1p(tokens), self.log_l)]))))
        return {"score": alpha * raw + (1 - alpha) * trajectory, "trajectory": trajectory, "alpha": alpha}

    def udf(self, states: Column, reward: Column, tokens: Column) -> Column:
        def run(states: pd.Series, reward: pd.Series, tokens: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.score(np.stack([np.asarray(r, float) for r in s]), r, n) for s, r, n in zip(states, reward, tokens, strict=True)])

        return F.pandas_udf(run, "score double, trajectory double, alpha double")(states, reward, tokens)


#: Vectors of one layer that a probe is fitted on, at most, in hash order, and pairs of one question among them, drawn evenly.
PROBE_SAMPLE, PROBE_PAIRS = 20_000, 4096


def _digits(x: Column) -> Column:
    """A long as 16 hexadecimal digits in the order of its size."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def layer_probes(df: DataFrame, folds: int = 5, regularization: float = 0.01, seed: int = 1) -> DataFrame:
    """df: layer, question_uid, label, v. For each layer and fold: strict share of right-wrong pairs of held-out questions that a
    pairwise linear probe, fitted on the other folds, puts in order. Only the fit takes a sample, the first vectors of each layer in
    hash order up to an edge that ``corpus.hash_edges`` finds; each layer and fold is fitted in a task of its own. All held-out pairs
    count, by running sums over the scores."""
    h = F.concat(_digits(F.xxhash64(F.lit(seed), "question_uid")), _digits(F.xxhash64("v")))
    rows = df.withColumns({"fold": F.pmod(F.xxhash64(F.lit(seed), "question_uid"), F.lit(folds)).cast("int"), "h": h})
    edges = hash_edges(df, ["layer"], F.lit(PROBE_SAMPLE), h)

    def pairs(part: pd.DataFrame) -> np.ndarray:
        out = []
        for _, g in part.groupby("question_uid"):
            x, y = np.stack(g["v"].to_numpy()), g["label"].to_numpy()
            p, q = x[y == 1], x[y == 0]
            if n := len(p) * len(q):
                i, j = np.divmod(np.random.default_rng(seed).choice(n, min(n, PROBE_PAIRS), replace=False), len(q))
                out.append(p[i] - q[j])
        return np.concatenate(out) if out else np.zeros((0, 1))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out, part = [], part.sort_values("h")
        if len(d := pairs(part)):
            sd = np.maximum(np.stack(part["v"].to_numpy()).std(0), 1e-3)
            out.append((*key, fit_ranker(d / sd, regularization, 200) / sd))
        return pd.DataFrame(out, columns=["layer", "left_out", "w"])

    drawn = rows.join(F.broadcast(edges), "layer").where(F.col("h") <= F.col("edge"))  # edges: a row for each layer
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    weights = drawn.select("layer", "question_uid", "label", "v", "h", F.explode(others).alias("left_out")).groupBy("layer", "left_out").applyInPandas(fit, schema := "layer int, left_out int, w array<double>").collect()
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    known = F.broadcast(df.sparkSession.createDataFrame(weights, schema).withColumnRenamed("left_out", "fold"))
    held = rows.where(F.col("label").isin(0, 1)).join(known, ["layer", "fold"])
    counts = pair_counts(held.select("layer", "fold", "question_uid", "label", score.alias("score")), keys=("layer", "fold", "question_uid"))
    return counts.groupBy("layer", "fold").agg(F.sum("wins").alias("wins"), F.sum("pairs").alias("pairs")).where("pairs > 0").select(F.col("layer").cast("int"), "fold", (F.col("wins") / F.col("pairs")).alias("accuracy"))


def token_places(ends: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Index of the token that holds the last character before each end; -1 where none does."""
    starts = np.array([a for a, _ in spans])
    out = []
    for e in ends:
        k = int(np.searchsorted(starts, e - 1, "right")) - 1
        out.append(k if k >= 0 and spans[k][0] <= e - 1 < spans[k][1] else -1)
    return out
