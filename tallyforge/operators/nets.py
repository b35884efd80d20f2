"""Scoring heads over the chunk states of candidates, with their gradients.

A batch holds the states of many candidates end to end; nothing is padded. A head turns parameters (a dict of arrays) and a batch
into one score for each candidate, and gives a function that turns the scores' gradient into the parameters' gradient. Tasks run
these on the questions they hold; ``training`` adds the gradients up over Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import erf, pi

import numpy as np

Params = dict[str, np.ndarray]
Back = Callable[[np.ndarray], np.ndarray]


@dataclass
class Batch:
    """states: (chunks of all candidates, h); start: the first chunk of each candidate, and the end; raw: standardised rewards;
    sizes: standardised logarithms of chunks and tokens, a row for each candidate."""

    states: np.ndarray
    start: np.ndarray
    raw: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        n = np.diff(self.start)
        of = np.repeat(np.arange(len(n)), n)
        self.source = np.flatnonzero(of[1:] == of[:-1])  # chunks that another of the same candidate follows
        self.of = of[self.source]
        self.last = self.start[1:] - 1
        self.moves = n > 1

    def add(self, x: np.ndarray) -> np.ndarray:
        """Sums of rows of x, one for each change from chunk to chunk, by candidate."""
        out = np.zeros((len(self.raw), *x.shape[1:]))
        if len(x):
            first = np.flatnonzero(np.concatenate(([True], self.of[1:] != self.of[:-1])))
            out[self.of[first]] = np.add.reduceat(x, first)
        return out


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _linear(p: Params, g: Params, name: str, x: np.ndarray, bias: bool = True) -> tuple[np.ndarray, Back]:
    def back(d: np.ndarray) -> np.ndarray:
        g[f"{name}.w"] = g.get(f"{name}.w", 0) + d.T @ x
        if bias:
            g[f"{name}.b"] = g.get(f"{name}.b", 0) + d.sum(0)
        return d @ p[f"{name}.w"]

    return x @ p[f"{name}.w"].T + (p[f"{name}.b"] if bias else 0.0), back


def _norm(x: np.ndarray, p: Params | None = None, g: Params | None = None, name: str = "") -> tuple[np.ndarray, Back]:
    """Rows less their mean over their deviation; with a name also scaled and shifted by parameters."""
    inverse = 1 / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    y = (x - x.mean(1, keepdims=True)) * inverse

    def back(d: np.ndarray) -> np.ndarray:
        if name:
            g[f"{name}.w"], g[f"{name}.b"] = g.get(f"{name}.w", 0) + (d * y).sum(0), g.get(f"{name}.b", 0) + d.sum(0)
            d = d * p[f"{name}.w"]
        return inverse * (d - d.mean(1, keepdims=True) - y * (d * y).mean(1, keepdims=True))

    return (y * p[f"{name}.w"] + p[f"{name}.b"] if name else y), back


def _relu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    return np.maximum(x, 0), lambda d: d * (x > 0)


def _gelu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    below = 0.5 * (1 + np.array([erf(v) for v in (x / np.sqrt(2)).ravel()]).reshape(x.shape))
    return x * below, lambda d: d * (below + x * np.exp(-x * x / 2) / np.sqrt(2 * pi))


def _chain(x: np.ndarray, *steps: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> tuple[np.ndarray, Back]:
    backs = []
    for step in steps:
        x, back = step(x)
        backs.append(back)

    def all_back(d: np.ndarray) -> np.ndarray:
        for back in reversed(backs):
            d = back(d)
        return d

    return x, all_back


def _uniform(rng: np.random.Generator, out: int, into: int, name: str, bias: bool = True) -> Params:
    edge = 1 / np.sqrt(into)
    return {f"{name}.w": rng.uniform(-edge, edge, (out, into))} | ({f"{name}.b": rng.uniform(-edge, edge, out)} if bias else {})


@dataclass(frozen=True)
class Trajectory:
    """Mixes a candidate's reward with the evidence that its chunks gain: a probe values each state, a gate weighs each gain, late
    gains count more, and alpha tells how far the reward is kept. One chunk: the reward as it is."""

    hidden: int
    gate_size: int = 32
    alpha_size: int = 16
    gamma: float = 0.9
    keep: float = 0.9

    def init(self, seed: int) -> Params:
        rng = np.random.default_rng(seed)
        p = _uniform(rng, 1, self.hidden, "probe") | _uniform(rng, self.gate_size, 2 * self.hidden + 1, "gate1") | _uniform(rng, 1, self.gate_size, "gate2") | _uniform(rng, self.alpha_size, 5, "alpha1")
        return p | {"alpha2.w": np.zeros((1, self.alpha_size)), "alpha2.b": np.array([np.log(self.keep / (1 - self.keep))])}

    def forward(self, p: Params, b: Batch) -> tuple[np.ndarray, Callable[[np.ndarray], Params]]:
        g: Params = {}
        h, _ = _norm(b.states)  # the states aren't trained, so nothing goes back through this
        z, back_z = _linear(p, g, "probe", h)
        z = z[:, 0]
        gain = z[b.source + 1] - z[b.source]
        gate, back_gate = _chain(np.column_stack((h[b.source], h[b.source + 1], gain)), lambda x: _linear(p, g, "gate1", x), _gelu, lambda x: _linear(p, g, "gate2", x))
        gate = expit(gate[:, 0])
        decay = self.gamma ** (b.last[b.of] - b.source - 1)
        w = decay * gate
        total = b.add(w)
        floor = np.maximum(total, 1e-6)
        gained = b.add(w * gain) / floor
        alpha, back_alpha = _chain(np.column_stack((b.raw, z[b.last], gained, b.sizes)), lambda x: _linear(p, g, "alpha1", x), _gelu, lambda x: _linear(p, g, "alpha2", x))
        alpha = expit(alpha[:, 0])
        score = np.where(b.moves, alpha * b.raw + (1 - alpha) * gained, b.raw)

        def back(d: np.ndarray) -> Params:
            d = np.where(b.moves, d, 0.0)
            d_in = back_alpha((d * (b.raw - gained) * alpha * (1 - alpha))[:, None])
            d_gained = d * (1 - alpha) + d_in[:, 2]
            share = (d_gained / floor)[b.of]
            held = np.where(total > 1e-6, gained, 0.0)[b.of]  # below the floor the total doesn't matter
            d_w = share * (gain - held)
            d_gate = back_gate((d_w * decay * gate * (1 - gate))[:, None])
            d_gain = share * w + d_gate[:, -1]
            d_z = np.zeros(len(z))
            d_z[b.last] += d_in[:, 1]
            np.add.at(d_z, b.source + 1, d_gain)
            np.add.at(d_z, b.source, -d_gain)
            back_z(d_z[:, None])
            return g

        return score, back


def _pooled(p: Params, g: Params, b: Batch) -> tuple[np.ndarray, Back]:
    """Gated mean and deviation of the embedded changes from chunk to chunk."""
    h, back_h = _chain(b.states, lambda x: _linear(p, g, "projection", x, bias=False), _norm)
    e, back_e = _chain(h[b.source + 1] - h[b.source], lambda x: _linear(p, g, "change", x), _relu)
    gate, back_gate = _linear(p, g, "source", h[b.source])
    w = expit(gate)  # a column
    total = b.add(w)
    floor = np.maximum(total, 1e-8)
    mean = b.add(w * e) / floor
    away = e - mean[b.of]
    variance = b.add(w * away * away) / floor
    deviation = np.sqrt(np.maximum(variance, 0.0) + 1e-8)

    def back(d: np.ndarray) -> np.ndarray:
        k = e.shape[1]
        d_var = d[:, k:] / (2 * deviation)
        d_mean = d[:, :k] - 2 * d_var * b.add(w * away) / floor
        by_var, by_mean = (d_var / floor)[b.of], (d_mean / floor)[b.of]
        d_e = w * (by_mean + 2 * by_var * away)
        d_w = (by_var * away * away + by_mean * e).sum(1, keepdims=True)
        d_w -= np.where(total > 1e-8, (d_var * variance + d_mean * mean).sum(1, keepdims=True) / floor, 0.0)[b.of]
        d_h = np.zeros_like(h)
        d_change = back_e(d_e)
        np.add.at(d_h, b.source + 1, d_change)
        np.add.at(d_h, b.source, back_gate(d_w * w * (1 - w)) - d_change)
        return back_h(d_h)

    return np.concatenate((mean, deviation), 1), back


@dataclass(frozen=True)
class LocalEndpoint:
    """Score of the last state, plus a scaled score of the pooled changes before it; one chunk has no changes."""

    hidden: int
    projection: int = 128
    change: int = 32
    local: int = 96
    end1: int = 256
    end2: int = 64

    def init(self, seed: int) -> Params:
        rng = np.random.default_rng(seed)
        p = _uniform(rng, self.projection, self.hidden, "projection", False) | _uniform(rng, self.change, self.projection, "change") | _uniform(rng, 1, self.projection, "source")
        p |= {"pool.w": np.ones(2 * self.change), "pool.b": np.zeros(2 * self.change)} | _uniform(rng, self.local, 2 * self.change, "local1") | _uniform(rng, 1, self.local, "local2")
        p |= _uniform(rng, self.end1, self.hidden, "end1") | {"norm1.w": np.ones(self.end1), "norm1.b": np.zeros(self.end1)} | _uniform(rng, self.end2, self.end1, "end2")
        return p | {"norm2.w": np.ones(self.end2), "norm2.b": np.zeros(self.end2)} | _uniform(rng, 1, self.end2, "end3") | {"scale": np.ones(1)}

    def forward(self, p: Params, b: Batch) -> tuple[np.ndarray, Callable[[np.ndarray], Params]]:
        g: Params = {}
        pooled, back_pool = _pooled(p, g, b)
        local, back_local = _chain(pooled, lambda x: _norm(x, p, g, "pool"), lambda x: _linear(p, g, "local1", x), _relu, lambda x: _linear(p, g, "local2", x))
        local = np.where(b.moves, local[:, 0], 0.0)
        end, back_end = _chain(
            b.states[b.last], lambda x: _linear(p, g, "end1", x), lambda x: _norm(x, p, g, "norm1"), _relu,
            lambda x: _linear(p, g, "end2", x), lambda x: _norm(x, p, g, "norm2"), _relu, lambda x: _linear(p, g, "end3", x),
        )

        def back(d: np.ndarray) -> Params:
            back_end(d[:, None])
            back_pool(back_local((np.where(b.moves, d, 0.0) * p["scale"][0])[:, None]))
            g["scale"] = np.array([(d * local).sum()])
            return g

        return end[:, 0] + p["scale"][0] * local, back


@dataclass(frozen=True)
class BoundedResidual:
    """The reward, which stays as it is, plus cap x tanh of a score of the pooled changes; untrained, the residual is zero."""

    hidden: int
    projection: int = 128
    change: int = 32
    local: int = 96
    cap: float = 0.5

    def init(self, seed: int) -> Params:
        rng = np.random.default_rng(seed)
        p = _uniform(rng, self.projection, self.hidden, "projection", False) | _uniform(rng, self.change, self.projection, "change") | _uniform(rng, 1, self.projection, "source")
        return p | _uniform(rng, self.local, 2 * self.change, "local1") | {"local2.w": np.zeros((1, self.local)), "local2.b": np.zeros(1)}

    def forward(self, p: Params, b: Batch) -> tuple[np.ndarray, Callable[[np.ndarray], Params]]:
        g: Params = {}
        pooled, back_pool = _pooled(p, g, b)
        local, back_local = _chain(pooled, _norm, lambda x: _linear(p, g, "local1", x), _relu, lambda x: _linear(p, g, "local2", x))
        bent = np.tanh(np.where(b.moves, local[:, 0], 0.0))

        def back(d: np.ndarray) -> Params:
            back_pool(back_local((np.where(b.moves, d, 0.0) * self.cap * (1 - bent * bent))[:, None]))
            return g

        return b.raw + self.cap * bent, back


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


@dataclass(frozen=True)
class QuestionLoss:
    """For each question: -log of the right candidates' share in a softmax, plus pair x mean softplus of wrong less right scores,
    plus calibration x mean squared error of the scores' sigmoid. A batch is the mean over its questions."""

    pair: float = 0.5
    calibration: float = 0.1

    def of(self, score: np.ndarray, label: np.ndarray, raw: np.ndarray, seed: int) -> tuple[float, float, np.ndarray]:
        """Sum of losses, what it is divided by, and the gradient of the sum, for one question with both labels."""
        right = label > 0.5

        def softmax(x: np.ndarray) -> tuple[float, np.ndarray]:
            top = x.max()
            e = np.exp(x - top)
            return top + np.log(e.sum()), e / e.sum()

        every, d = softmax(score)
        some, of_right = softmax(score[right])
        loss, d[right] = every - some, d[right] - of_right
        p, q = score[right], score[~right]
        for i in range(0, len(p), max(1, (1 << 20) // len(q))):  # a block of right candidates at a time
            j = slice(i, i + max(1, (1 << 20) // len(q)))
            x = q - p[j, None]
            loss += self.pair * _softplus(x).sum() / (len(p) * len(q))
            s = self.pair * expit(x) / (len(p) * len(q))
            d[np.flatnonzero(right)[j]] -= s.sum(1)
            d[~right] += s.sum(0)
        share = expit(score)
        loss += self.calibration * ((share - label) ** 2).mean()
        d += self.calibration * 2 * (share - label) * share * (1 - share) / len(score)
        return float(loss), 1.0, d


@dataclass(frozen=True)
class PairLoss:
    """Mean softplus of wrong less right scores over at most cap pairs of a question, drawn evenly, plus penalty x the mean square of
    what the head adds to the reward at both ends of the pairs. A batch is the mean over its pairs."""

    cap: int = 256
    penalty: float = 0.0

    def of(self, score: np.ndarray, label: np.ndarray, raw: np.ndarray, seed: int) -> tuple[float, float, np.ndarray]:
        p, q = np.flatnonzero(label > 0.5), np.flatnonzero(label <= 0.5)
        n = len(p) * len(q)
        at = np.arange(n) if n <= self.cap else np.sort(np.random.default_rng(seed).choice(n, self.cap, replace=False))
        i, j = p[at // len(q)], q[at % len(q)]
        x, added, d = score[j] - score[i], score - raw, np.zeros(len(score))
        s = expit(x)
        np.add.at(d, i, -s + self.penalty * added[i])
        np.add.at(d, j, s + self.penalty * added[j])
        return float(_softplus(x).sum() + self.penalty * (added[i] ** 2 + added[j] ** 2).sum() / 2), float(len(at)), d
