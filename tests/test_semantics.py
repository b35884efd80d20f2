"""Ties, missing answers, one-sided questions, no variance, gates, budgets: by hand and by invariants."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, budget, clusters, corpus, gates, learn, metrics, resample, select, sequences, stats

SCHEMA = "question_uid string, candidate_index bigint, answer string, rm double, label int, solution string"


def cand(spark, *questions):
    """Each question: rows of (answer, rm, label)."""
    return spark.createDataFrame([(f"q{k}", i, a, rm, y, f"s {a} {i % 2}") for k, q in enumerate(questions) for i, (a, rm, y) in enumerate(q)], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(5)
    qs = [[(r.choice(["A", "B", "C", None]), float(r.choice([1, 2, 3, 4])) if k % 2 else r.gauss(0, 3), r.randint(0, 1)) for _ in range(r.randint(1, 9))] for k in range(40)]
    return cand(spark, *qs), qs


def one(df):
    return df.collect()[0].asDict()


def test_first_of_tied_scores_is_chosen(spark):
    c = cand(spark, [("A", 2.0, 0), ("B", 2.0, 1), ("C", 1.0, 1)])
    assert one(clusters.raw_choice(c))["candidate_index"] == 0
    t = one(metrics.tie_diagnostics(c))
    assert (t["top1"], t["optimistic_top1"], t["tie_aware_top1"], t["tie_rate"]) == (0, 1, 0.5, 1)


def test_unparsed_candidates_stay_apart(spark):
    c = clusters.clusters(cand(spark, [("A", 1.0, 1), (None, 2.0, 0), (None, 3.0, 0)]))
    assert sorted(x.n for x in c.collect()) == [1, 1, 1]


def test_one_sided_questions_have_no_pair_metric(spark):
    c = cand(spark, [("A", 1.0, 1), ("B", 2.0, 1)], [("A", 1.0, 0), ("B", 2.0, 0)]).withColumn("score", F.col("rm"))
    m = one(metrics.ranking_metrics(metrics.question_outcomes(c)))
    assert m["pair_macro_strict"] is None and m["eligible"] == 0 and m["top1"] == 0.5


def test_z_without_variance(spark):
    c = cand(spark, [("A", 5.0, 1), ("B", 5.0, 0)], [("A", 1.0, 1), ("A", 1.0, 1), ("A", 1.0, 1), ("A", 9.0, 0)])
    assert [x.z for x in clusters.with_z(c).where("question_uid = 'q0'").collect()] == [0, 0]
    z = {(x.question_uid, x.candidate_index): x.z for x in clusters.with_robust_z(c).collect()}
    assert z["q0", 0] == 0 and z["q1", 3] == pytest.approx(8 / math.sqrt(12))  # MAD 0: the deviation counts


def gated(spark, threshold):
    c = cand(spark, [("A", 2.0, 0), ("B", 1.0, 1), ("B", 1.0, 1)])
    s = spark.createDataFrame([("q0", "a:A", 1.0, 0), ("q0", "a:B", 1.5, 1)], "question_uid string, cluster string, cluster_score double, first_index bigint")
    e = select.expand(c, s, threshold)
    return e.orderBy(F.desc("score"), "candidate_index").first().candidate_index


def test_gate_is_strict_and_infinite_gate_keeps_raw(spark):
    assert gated(spark, 0.5) == 0 and gated(spark, 0.49) == 1 and gated(spark, float("inf")) == 0 and gated(spark, 0.0) == 1


def test_budget_limits(spark, mixed):
    df, qs = mixed
    p = {(x.question_uid, x.k): x.pass_at_k for x in budget.pass_at_k(df, [1, 2, 3, 4]).collect()}
    b = {(x.question_uid, x.k): x.best_at_k for x in budget.best_at_k(df, [1, 2, 3, 4]).collect()}
    for k, q in enumerate(qs):
        for size in (1, 2, 3, 4):
            key = (f"q{k}", size)
            if len(q) < size:
                assert key not in p and key not in b
                continue
            subsets = list(combinations(range(len(q)), size))
            assert p[key] == pytest.approx(sum(any(q[i][2] for i in s) for s in subsets) / len(subsets))
            assert b[key] == pytest.approx(sum(q[max(s, key=lambda i: (q[i][1], -i))][2] for s in subsets) / len(subsets))
            assert b[key] <= p[key] + 1e-12


def test_pair_counts_are_those_of_the_pairs(spark, mixed):
    df, qs = mixed
    got = {x.question_uid: (x.wins, x.ties, x.pairs) for x in metrics.pair_counts(df, "rm").collect()}
    for k, q in enumerate(qs):
        d = [x[1] - y[1] for x in q for y in q if x[2] == 1 and y[2] == 0]
        assert got[f"q{k}"] == (sum(x > 0 for x in d), sum(x == 0 for x in d), len(d))


def test_auc_is_the_share_of_ordered_pairs(spark, mixed):
    df, qs = mixed
    p, n = [x[1] for q in qs for x in q if x[2]], [x[1] for q in qs for x in q if not x[2]]
    assert one(metrics.auc(df))["auc"] == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in p for y in n) / len(p) / len(n))


@pytest.mark.parametrize("ties", [False, True])
def test_counted_subsets_are_those_made_one_by_one(ties):
    """Clusters of any size, rewards with and without ties across clusters."""
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 10)
        rm = [float(r.choice([1, 2, 3])) if ties else r.gauss(0, 2) for _ in range(n)]
        label, of = [r.randint(0, 1) for _ in range(n)], [r.randint(0, 3) for _ in range(n)]
        groups = [[i for i in range(n) if of[i] == g] for g in sorted(set(of))]
        for k in range(1, n + 1):
            want = dict.fromkeys(("raw", "majority", "weighted"), 0)
            for x in combinations(range(n), k):
                own = [[i for i in g if i in x] for g in groups]
                own = [g for g in own if g]
                best = lambda g: label[max(g, key=lambda i: (rm[i], -i))]
                mass = lambda g: round(4 * (max(rm[i] for i in g) / 4 + math.log(sum(math.exp(rm[i] / 4 - max(rm[j] for j in g) / 4) for i in g))), 9)
                top = lambda g: (max(rm[i] for i in g), -min(g))
                want["raw"] += best(x)
                want["majority"] += best(max(own, key=lambda g: (len(g), *top(g))))
                want["weighted"] += best(max(own, key=lambda g: (mass(g), *top(g))))
            assert resample.raw_share(groups, rm, label, k) == want["raw"]
            assert resample.majority_share(groups, rm, label, k) == want["majority"]
            assert resample.weighted_share(groups, rm, label, k, 4.0) == want["weighted"]


def test_many_candidates_are_counted_at_once():
    import time

    r = random.Random(9)
    rm, label = [r.gauss(0, 1) for _ in range(64)], [r.randint(0, 1) for _ in range(64)]
    groups = [list(range(g, 64, 8)) for g in range(8)]
    began = time.perf_counter()
    share = resample.majority_share(groups, rm, label, 16) / math.comb(64, 16)
    assert 0 < share < 1 and time.perf_counter() - began < 2  # 5e14 subsets
    drawn = [sorted(r.sample(range(64), 16)) for _ in range(4000)]
    best = [max(([i for i in g if i in set(x)] for g in groups), key=lambda g: (len(g), max((rm[i] for i in g), default=-9))) for x in drawn]
    assert abs(share - sum(label[max(g, key=lambda i: rm[i])] for g in best) / 4000) < 0.04


def test_exact_subsets_of_raw_rule_is_best_at_k(spark, mixed):
    df, _ = mixed
    a = {x.question_uid: x.raw for x in resample.exact_subsets(df, 3).collect()}
    b = {x.question_uid: x.best_at_k for x in budget.best_at_k(df, [3]).collect()}
    assert a == pytest.approx(b)


def test_noise_of_sigma_zero_keeps_the_choice(spark, mixed):
    df, _ = mixed
    n = resample.group_noise(df, 0.0, 1)
    assert n.where("abs(noisy - z) > 1e-12").count() == 0
    o = metrics.question_outcomes(n.withColumn("score", F.round("noisy", 9)))
    assert o.where("switched = 1").count() == 0


def test_bootstrap_covers_the_mean(spark):
    rec = spark.createDataFrame([(i, float(i % 2), 1 if i % 4 == 1 else 0, 1) for i in range(400)], "question_uid int, x double, num int, den int")
    i = one(resample.interval(resample.bootstrap(rec, ["x"], {"r": ("num", "den")}, 300, 3), "x"))
    assert i["lower"] < 0.5 < i["upper"] and 0.08 < i["upper"] - i["lower"] < 0.12 and i["p_positive"] == 1
    a, b = (resample.bootstrap(x, ["x"], {}, 5, 1).orderBy("sample").collect() for x in (rec, rec.repartition(7)))
    assert a == b and len(a) == 5


def test_draws_are_poisson_counts():
    steps = [0, *resample.poisson_steps(), 1 << resample.BITS]
    share = [(b - a) / (1 << resample.BITS) for a, b in zip(steps[:-1], steps[1:], strict=True)]
    assert abs(sum(k * p for k, p in enumerate(share)) - 1) < 1e-3 and abs(sum(k * k * p for k, p in enumerate(share)) - 2) < 5e-3


def test_ranker_learns_the_direction():
    import numpy as np

    x = np.random.default_rng(0).standard_normal((500, 8))
    x[:, 2] = np.abs(x[:, 2])
    w = learn.fit_ranker(x, 0.01)
    assert w[2] > 1 and np.abs(np.delete(w, 2)).max() < 0.7


def test_logistic_matches_gradient_zero():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    y = (x[:, 0] + rng.standard_normal(300) > 0).astype(float)
    w, b, mean, sd = gates.fit_logistic(x, y)
    a = (x - mean) / sd
    p = 1 / (1 + np.exp(-(a @ w + b)))
    assert np.allclose(a.T @ (p - y) + w / 0.25, 0, atol=1e-6) and abs((p - y).sum()) < 1e-6
    assert gates.fit_logistic(x, np.zeros(300))[1] < -5 and gates.fit_logistic(x[:0], y[:0])[1] == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_gates_over_partitions_equal_one_matrix(spark, parts):
    """All folds and targets at once, by sums over tasks, against a fit of the collected rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 4)) * [1, 100, 1e-3, 0] + [0, 5e5, 1, 0.1]
    y = (x[:, 0] + rng.standard_normal(400) > 0.5).astype(int)
    fold = rng.integers(0, 3, 400)
    rows = [(*map(float, v), int(t), int(f)) for v, t, f in zip(x, y, fold, strict=True)] + [(None, 1.0, 1.0, 0.1, 1, 0), (float("nan"), 1.0, 1.0, 0.1, 1, 0), (1.0, 1.0, 1.0, 0.1, None, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, fold int").repartition(parts)
    targets = [(F.col("y"), F.when(F.col("y") == 1, 3.0).otherwise(1.0)), (1 - F.col("y"), F.lit(1.0)), (F.col("y") * 0, F.lit(1.0))]
    got = gates.fit_gates(df, ["a", "b", "c", "d"], targets, F.col("fold"), 3)
    for t, (own, w) in enumerate([(y, np.where(y == 1, 3.0, 1.0)), (1 - y, np.ones(400)), (y * 0, np.ones(400))]):
        for k in range(4):
            some = fold != k
            want = gates.fit_logistic(x[some], own[some].astype(float), w[some])
            for a, b in zip(got[t][k], want, strict=True):
                assert np.allclose(a, b, rtol=1e-9, atol=1e-9), (t, k)
    alone = gates.fit_gates(df, ["a", "b", "c", "d"], targets[:1])
    assert len(alone[0]) == 1 and np.allclose(alone[0][0][0], got[0][3][0], rtol=1e-9, atol=1e-9)
    empty = gates.fit_gates(df.where("false"), ["a", "b"], targets[:1], F.col("fold"), 2)
    assert [m[1] for m in empty[0]] == [0.0, 0.0, 0.0]


def test_stratified_split_sizes_and_disjointness(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 30 else "c") for i in range(40)], "id int, s string")
    got = corpus.stratified_split(df, "id", F.col("s"), {"train": 0.65, "a": 0.1, "b": 0.1, "test": 0.15}, "x")
    n = {(x.s, x.split): x["count"] for x in got.groupBy("s", "split").count().collect()}
    assert got.count() == 40 and n["c", "train"] == 7 and sum(v for (s, _), v in n.items() if s == "c") == 10
    again = {x.id: x.split for x in corpus.stratified_split(df.repartition(7), "id", F.col("s"), {"train": 0.65, "a": 0.1, "b": 0.1, "test": 0.15}, "x").collect()}
    assert again == {x.id: x.split for x in got.collect()}


def test_fuzzy_best_misses_nothing_within_the_cutoff(spark):
    from tallyforge.functions.text import indel_ratio

    r = random.Random(2)
    texts = ["".join(r.choices("abc ", k=r.randint(1, 60))) for _ in range(60)]
    a, b = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(i, t[:-1] + "x") for i, t in enumerate(texts)], "j int, u string")
    got = {x.i: x.score for x in corpus.fuzzy_best(a, b, "i", "t", "j", "u", 70.0).collect()}
    for i, t in enumerate(texts):
        best = max(indel_ratio(t, u[:-1] + "x") for u in texts)
        assert got.get(i) == (pytest.approx(best) if best >= 70 else None)


def test_fuzzy_best_of_prose_and_odd_texts(spark):
    """Near copies among texts of like words, at the cutoff of an audit; short texts, other scripts, equal texts."""
    from tallyforge.functions.text import indel_ratio

    r = random.Random(4)
    words = ["".join(r.choices("etaoinshr", k=r.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(60)] + ["a", "ab", "abc", "日本語の文", "日本語の文章", "🙂🙂🙂", "x" * 50, "x" * 48]

    def changed(t):
        out = list(t)
        for _ in range(r.randint(0, max(1, len(t) // 18))):
            i = r.randrange(len(out) + 1)
            out[i : i + r.randint(0, 1)] = r.choice(["", "q", "e "])
        return "".join(out)

    others = [changed(t) for t in texts] + texts[:3]
    a, b = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(others)), "j int, u string")
    got = {x.i: (x.score, x.external_id) for x in corpus.fuzzy_best(a, b, "i", "t", "j", "u", 92.0).collect()}
    for i, t in enumerate(texts):
        best = max((indel_ratio(t, u), -j) for j, u in enumerate(others) if t and u)
        assert got.get(i) == ((pytest.approx(best[0]), -best[1]) if best[0] >= 92 else None)
    assert len(got) > 30


def test_contract_and_require(spark):
    good = cand(spark, [("A", 1.0, 1), ("B", 2.0, 0)])
    audit.require(audit.candidate_contract(good))
    bad = good.withColumn("candidate_index", F.col("candidate_index") + 1).withColumn("rm", F.lit(float("nan"))).withColumn("answer_key", F.lit(1))
    with pytest.raises(ValueError, match="incomplete_indices: 1; not_finite: 2; forbidden_fields: 1"):
        audit.require(audit.candidate_contract(bad))


def test_sequences(spark):
    v = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array().cast("array<double>").alias("e"))
    x = v.select(sequences.norm(F.col("a")), sequences.differences(F.col("a")), sequences.differences(F.col("e")), sequences.tail_mean(F.col("a"), 8), sequences.ragged(F.col("a"), F.lit(1), F.lit(2))).first()
    assert list(x) == [5.0, [1.0], [], 3.5, [4.0]]
    one_each = cand(spark, [("A", 1.0, 1)])
    assert one(sequences.support_entropy(one_each))["support_margin"] == 1 and one(sequences.max_of_others(one_each))["max_other"] == 1.0
    assert one(sequences.decayed_change(one_each, "rm", F.lit(1.0), 0.9))["reward"] == 0


def test_leave_one_out_is_the_correlation_of_the_rest(spark):
    r = random.Random(3)
    rows = [(k, r.random(), r.random()) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {x.k: x.pearson for x in stats.leave_one_out(df, "k", "x", "y").collect()}
    assert got == pytest.approx({k: df.where(F.col("k") != k).agg(F.corr("x", "y")).first()[0] for k in range(6)})


def test_tie_band():
    rows = [{"top1": 0.800, "pair": 0.6, "damage": 0.1}, {"top1": 0.803, "pair": 0.5, "damage": 0.0}, {"top1": 0.798, "pair": 0.6, "damage": 0.05}, {"top1": 0.9, "pair": 0.1, "damage": 0.5}]
    assert learn.tie_band_choice(rows[:3]) == rows[2] and learn.tie_band_choice(rows) == rows[3] and learn.tie_band_choice([]) is None


def test_contains_matches_of_any_length(spark):
    r = random.Random(6)
    texts = [" ".join(r.choices(["ab", "b", "abc", "ca"], k=r.randint(1, 12))) for _ in range(60)]
    items = [t for t in ("a", "b ca", "b ca ab", "c ab b a", "bc ca b ab c", "", "zz") for t in [t]]
    a, b = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(items)), "j int, u string")
    got = {(x.i, x.j) for x in corpus.contains_matches(a, b, "i", "t", "j", "u").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, u in enumerate(items) if u and u in t} and len(got) > 20


def test_fuzzy_top_beyond_the_broadcast(spark, monkeypatch):
    from tallyforge.operators import corpus

    df = spark.createDataFrame([(i, f"some text {i * 7} of row {i % 5}") for i in range(40)], "q int, t string")
    others = df.toDF("item_id", "text")
    top = lambda: corpus.fuzzy_top(df, others, "q", "t", "item_id", "text", 5)
    want = sorted(top().collect())
    monkeypatch.setattr(corpus, "FUZZY_BROADCAST", 0)
    large = top()
    assert "CartesianProduct" in large._jdf.queryExecution().toString() and sorted(large.collect()) == want and len(want) == 200
