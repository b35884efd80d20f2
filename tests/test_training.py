"""Heads against finite differences and one by one; training that resumes, on any number of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import models, nets, sums, training
from tallyforge.sources import scratch

H = 6
HEADS = [nets.Trajectory(H, 5, 4), nets.LocalEndpoint(H, 5, 4, 6, 7, 5), nets.BoundedResidual(H, 5, 4, 6)]
LOSSES = [nets.QuestionLoss(), nets.PairLoss(4, 0.1), nets.PairLoss()]


def batch(seed, n=7):
    r = np.random.default_rng(seed)
    k = np.array([1, *r.integers(1, 6, n - 1)])
    return nets.Batch(r.standard_normal((k.sum(), H)), np.concatenate(([0], np.cumsum(k))), r.standard_normal(n), r.standard_normal((n, 2))), np.array([1, 0, 1, 0, 0, 1, 0][:n], float)


def warm(head, seed=0):
    """Parameters with none at zero."""
    r = np.random.default_rng(seed)
    return {k: v + 0.3 * r.standard_normal(v.shape) for k, v in head.init(seed).items()}


@pytest.mark.parametrize("loss", LOSSES, ids=str)
@pytest.mark.parametrize("head", HEADS, ids=lambda h: type(h).__name__)
def test_gradients_are_finite_differences(head, loss):
    b, label = batch(3)
    p = warm(head)

    def value(q):
        return loss.of(head.forward(q, b)[0], label, b.raw, 5)[0]

    score, back = head.forward(p, b)
    got = back(loss.of(score, label, b.raw, 5)[2])
    assert set(got) == set(p)
    r = np.random.default_rng(1)
    for k, v in p.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in v.shape)
            up, down = ({**p, k: v.copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert got[k][at] == pytest.approx((value(up) - value(down)) / 2e-6, rel=2e-4, abs=1e-7), (k, at)


@pytest.mark.parametrize("head", HEADS, ids=lambda h: type(h).__name__)
def test_candidates_do_not_meet(head):
    """A batch gives what its candidates give one by one, single chunks among them."""
    b, _ = batch(4)
    p = warm(head)
    every = head.forward(p, b)[0]
    for i in range(len(b.raw)):
        one = nets.Batch(b.states[b.start[i] : b.start[i + 1]], np.array([0, b.start[i + 1] - b.start[i]]), b.raw[i : i + 1], b.sizes[i : i + 1])
        assert head.forward(p, one)[0][0] == pytest.approx(every[i], abs=1e-12)


def test_one_chunk_and_untrained_residual():
    b, _ = batch(5)
    assert nets.Trajectory(H).forward(warm(nets.Trajectory(H)), b)[0][0] == b.raw[0]
    assert (nets.BoundedResidual(H).forward(nets.BoundedResidual(H).init(1), b)[0] == b.raw).all()
    bent = nets.BoundedResidual(H, cap=0.2)
    far = {k: 50 * v for k, v in warm(bent).items()}
    assert (np.abs(bent.forward(far, b)[0] - b.raw) <= 0.2 + 1e-12).all()


def test_trajectory_head_as_scored_elsewhere():
    """The trained parameters, put into the scoring head of models, score the same (but for its way to avoid a division by zero)."""
    head = nets.Trajectory(H, 5, 4)
    p, r = warm(head), np.random.default_rng(2)
    states, reward, tokens = r.standard_normal((4, H)), 1.5, 30
    sized = models.TrajectoryHead(p["probe.w"][0], p["probe.b"][0], (p["gate1.w"], p["gate1.b"], p["gate2.w"][0], p["gate2.b"][0]), (p["alpha1.w"], p["alpha1.b"], p["alpha2.w"][0], p["alpha2.b"][0]), (0.5, 2.0), (1.0, 0.5), (3.0, 1.5))
    b = nets.Batch(states, np.array([0, 4]), np.array([(reward - 0.5) / 2]), np.array([[(np.log1p(4) - 1) / 0.5, (np.log1p(tokens) - 3) / 1.5]]))
    assert head.forward(p, b)[0][0] == pytest.approx(sized.score(states, reward, tokens)["score"], abs=1e-4)


def test_losses_by_their_definition():
    s, y, raw = np.array([0.3, -1.0, 2.0, 0.1]), np.array([1.0, 0, 0, 1]), np.array([0.0, 0.5, 1.0, 0.0])
    soft = np.log1p(np.exp(-np.subtract.outer(s[[0, 3]], s[[1, 2]])))
    want = np.log(np.exp(s).sum()) - np.log(np.exp(s[[0, 3]]).sum()) + 0.5 * soft.mean() + 0.1 * ((1 / (1 + np.exp(-s)) - y) ** 2).mean()
    assert nets.QuestionLoss().of(s, y, raw, 1)[0] == pytest.approx(want)
    value, pairs, _ = nets.PairLoss(256, 0.1).of(s, y, raw, 1)
    added = (s - raw) ** 2
    ends = [added[i] + added[j] for i in (0, 3) for j in (1, 2)]
    assert (value / pairs, pairs) == (pytest.approx(soft.mean() + 0.1 * np.mean(ends) / 2), 4)
    assert nets.PairLoss(3).of(s, y, raw, 1)[1] == 3


def candidates(spark, n=30, seed=0):
    """Right candidates gain along their chunks."""
    r = np.random.default_rng(seed)
    rows = []
    for q in range(n):
        for i in range(4):
            label = int((q + i) % 3 == 0)
            k = int(r.integers(1, 5)) + 1
            states = r.standard_normal((k, H)) + np.linspace(0, 1, k)[:, None] * (2 * label - 1) * np.eye(H)[0] * 3
            rows.append(("ab"[q % 3 == 0], q, i, states.tolist(), float(r.standard_normal()), label, int(r.integers(5, 50))))
    return spark.createDataFrame(rows, "dataset string, question_uid long, candidate_index int, states array<array<double>>, reward double, label int, tokens int")


@pytest.fixture(scope="module")
def questions(spark):
    at = scratch.path(spark, "questions")
    training.question_rows(candidates(spark)).write.parquet(at)
    return spark.read.parquet(at)


def close(a, b, within):
    return set(a) == set(b) and all(np.abs(a[k] - b[k]).max() <= within for k in a)


def test_sums_of_long_vectors(spark):
    rows, size = spark.range(1000).repartition(7), 3 * sums.BLOCK + 5

    def part(batches):
        out = np.zeros(size)
        for b in batches:
            np.add.at(out, (b.column("id").to_numpy() * 977) % size, 1.0)
        return out

    got = sums.vector_sum(rows, part, size)
    assert len(got) == size and (got == np.bincount(np.arange(1000) * 977 % size, minlength=size)).all()
    assert (sums.vector_sum(rows.where("false"), part, size) == 0).all()


def test_gradient_is_that_of_one_process(spark, questions):
    head, loss = HEADS[0], nets.QuestionLoss()
    p, scale = warm(head), training.scale_of(questions)
    added, total, n = {k: np.zeros_like(v) for k, v in p.items()}, 0.0, 0
    import pyarrow as pa

    for b in pa.Table.from_pandas(questions.toPandas(), preserve_index=False).to_batches(max_chunksize=1):
        one, label, _ = training._batch(b, scale)
        score, back = head.forward(p, one)
        value, _, d = loss.of(score, label, one.raw, 0)
        total, n = total + value, n + 1
        for k, g in back(d).items():
            added[k] += g
    for parts in (1, 7):
        value, grads = training.gradient(questions.repartition(parts), head, p, loss, scale)
        assert value == pytest.approx(total / n, rel=1e-12) and close(grads, {k: g / n for k, g in added.items()}, 1e-12)
    value, grads = training.gradient(questions.where("false"), head, p, loss, scale)
    assert value == 0 and all((g == 0).all() for g in grads.values())


def test_steps_balance_data_sets(questions):
    sizes = {r["dataset"]: r["count"] for r in questions.groupBy("dataset").count().collect()}
    steps = training.epoch_steps(questions, sizes, 4, 1, 2, 3)
    n = steps.groupBy("step", "dataset").count().collect()
    assert {r["count"] for r in n} == {4} and len(n) == 2 * -(-max(sizes.values()) // 4)
    seen = {r["dataset"]: (r.lo, r.hi) for r in steps.groupBy("dataset", "question_uid").count().groupBy("dataset").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()}
    assert all(hi - lo <= 1 for lo, hi in seen.values())  # each as often as the others, but for the last round
    again = training.epoch_steps(questions, sizes, 4, 1, 3, 3)
    key = ["dataset", "question_uid", "step"]
    assert not again.select(*key).exceptAll(steps.select(*key)).isEmpty()  # another order in another epoch


def test_loss_falls_and_a_stopped_run_goes_on(spark, questions):
    head = nets.Trajectory(H, 5, 4)
    how = {"per_step": 4, "rate": 0.05, "tasks": 2, "seed": 3}
    whole = training.train(questions, questions, head, nets.QuestionLoss(), scratch.path(spark, "run"), epochs=3, **how)
    assert whole.history[-1]["loss"] < whole.history[0]["loss"] and whole.history[-1]["pair"] > whole.history[0]["raw_pair"]
    at = scratch.path(spark, "run")
    training.train(questions, questions, head, nets.QuestionLoss(), at, epochs=1, **how)
    files, _ = training._files(spark, at)
    jvm = spark.sparkContext._jvm
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{at}/epoch-00002/_temporary"))  # an epoch that was cut off
    rest = training.train(questions, questions, head, nets.QuestionLoss(), at, epochs=3, **how)
    assert close(rest.weights, whole.weights, 0) and rest.history == whole.history and rest.best == whole.best
    other = training.train(questions.repartition(5), questions, head, nets.QuestionLoss(), scratch.path(spark, "run"), epochs=3, **(how | {"tasks": 5}))
    assert close(other.weights, whole.weights, 1e-9)
    with pytest.raises(ValueError, match="other settings"):
        training.train(questions, questions, head, nets.QuestionLoss(pair=1.0), at, epochs=3, **how)


def test_residual_never_chosen_below_its_guard(spark, questions):
    head = nets.BoundedResidual(H, 5, 4, 6)
    run = training.train(questions, questions, head, nets.PairLoss(8, 0.1), scratch.path(spark, "run"), 15, training.guarded, epochs=2, rate=0.01, tasks=2)
    for r in run.history:
        assert not r["selected"] or (r["top1"] >= r["raw_top1"] - 0.005 and r["pair"] > r["raw_pair"])
    if not run.best:
        assert (run.weights["local2.w"] == 0).all()


def test_choice_of_epochs():
    a = {"top1": 0.5, "pair": 0.6, "damage": 0.1, "raw_top1": 0.5, "raw_pair": 0.55}
    assert training.banded(a, None) and training.banded(a | {"top1": 0.51}, a) and not training.banded(a | {"top1": 0.49, "pair": 0.9}, a)
    assert training.banded(a | {"top1": 0.496, "pair": 0.61}, a) and not training.banded(a, a) and training.banded(a | {"damage": 0.05}, a)
    assert training.guarded(a, None) and not training.guarded(a | {"pair": 0.55}, None) and not training.guarded(a | {"top1": 0.49}, None) and not training.guarded(a, a)


def test_odd_candidates_are_left_out(spark):
    c = candidates(spark, 2)
    odd = spark.createDataFrame([("a", None, 0, [[1.0] * H], 1.0, 1, 3), ("a", 90, 0, [], 1.0, 1, 3), ("a", 90, 1, None, 1.0, 0, 3), ("a", 91, 0, [[1.0] * H], None, 1, 3), ("a", 92, 0, [[1.0] * H], 1.0, None, 3), ("a", 93, 0, [[1.0] * H], float("nan"), 0, 3), (None, 94, 0, [[1.0] * H], 1.0, 1, None), (None, 94, 1, [[1.0] * H], 2.0, 0, 3)], c.schema)
    rows = training.question_rows(c.unionByName(odd)).collect()
    assert sorted((r.dataset, r.question_uid) for r in rows) == [("", 94), ("a", 1), ("b", 0)]
    with pytest.raises(ValueError, match="no question"):
        training.train(training.question_rows(odd.where("question_uid < 94")), training.question_rows(odd), HEADS[0], nets.QuestionLoss(), "/nowhere", 2)
