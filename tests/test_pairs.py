"""The ranker's pairs: the first in hash order, found without an order over all of them."""

import re

from pyspark.sql import functions as F

from tallyforge.operators import learn


def test_first_pairs_are_those_of_an_order(spark, monkeypatch):
    monkeypatch.setattr(learn, "PAIRS", 300)
    pairs, h = spark.range(0, 40_000, numPartitions=16), F.xxhash64(F.lit(7), "id")
    want = [x.id for x in pairs.orderBy(h, "id").limit(300).collect()]
    got = learn.first_pairs(pairs, h, "id")
    assert [x.id for x in got.collect()] == want
    assert got.toArrow().column("id").to_pylist() == want
    edge = int(re.search(r"<= (-?\d+)", got._jdf.queryExecution().optimizedPlan().toString())[1])
    assert pairs.where(F.shiftright(h, 64 - learn.LEAD) <= edge).count() < 330  # all that tasks give out, whatever their number


def test_fewer_pairs_than_asked_for_all_count(spark):
    assert sorted(x.id for x in learn.first_pairs(spark.range(50), F.xxhash64("id"), "id").collect()) == list(range(50))
    assert learn.first_pairs(spark.range(0), F.xxhash64("id"), "id").count() == 0


def test_models_of_all_seeds_share_the_features(spark):
    rows = [(q, i, "ab"[(q + i) % 2], float((q * 7 + i * 5) % 11), (i + q // 3) % 2, str(i)) for q in range(30) for i in range(5)]
    cand = spark.createDataFrame(rows, "question_uid int, candidate_index int, answer string, rm double, label int, solution string")
    assert learn.ranker_models(cand, (1, 2), 0.01) == [learn.fit_ranker(learn.pair_differences(cand, k), 0.01).tolist() for k in (1, 2)]
