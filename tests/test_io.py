"""Sources, sinks, resuming and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import readers, sinks
from tallyforge.streaming import upsert


def test_json_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1, "t": "x"}\n\n{"k": 2, "t": "y"}\n')
    assert [x.k for x in readers.records(spark, str(p), ["k"]).orderBy("k").collect()] == [1, 2]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"k": 1}\nnot json\n{"k": 3}\n')
    df = readers.tolerant_json_lines(spark, str(bad), "k int").cache()
    assert readers.invalid_count(df).first().asDict() == {"rows": 3, "invalid": 1}
    doc = tmp_path / "c.json"
    doc.write_text(json.dumps([{"id": 1, "in": {"text": "deep", "more": [{"text": "deeper"}]}}]))
    assert readers.records(spark, str(doc)).count() == 1
    assert sorted(json.loads(x.record)["text"] for x in readers.nested_records(spark, str(doc), "text").collect()) == ["deep", "deeper"]


def test_npy_and_checks(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = readers.npy_rows(spark, str(tmp_path / "s.npy")).orderBy("place").collect()
    assert [x.v for x in got] == [[0, 1], [2, 3], [4, 5]]
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, t string")
    with pytest.raises(ValueError, match="rows"):
        readers.checked(df, 3)
    with pytest.raises(ValueError, match="unique"):
        readers.unique_keyed(df, "k")
    with pytest.raises(Exception, match="without a score"):
        readers.attach_scores(df, spark.createDataFrame([(2, 0.5)], "k int, s double"), ["k"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    out = str(tmp_path / "o")
    sinks.write_json_lines(df, out)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json_lines(df, out)
    m = str(tmp_path / "m.json")
    h = sinks.write_manifest({"b": np.float64("nan"), "a": np.arange(2)}, m)
    assert json.loads(open(m).read()) == {"a": [0, 1], "b": None}
    assert sinks.file_hashes(spark, m).first().sha256 == h
    with pytest.raises(FileExistsError):
        sinks.write_manifest({}, m)
    assert sinks.canonical_hash({"b": 1, "a": [2]}) == sinks.canonical_hash({"a": [2], "b": 1}) and len(sinks.canonical_hash(1, 16)) == 16
    assert df.select(sinks.record_hash(F.col("k"), F.col("t"))).distinct().count() == 2


def test_resume_does_only_what_is_left(spark, tmp_path):
    out, seen = str(tmp_path / "parts"), []
    df = spark.range(10).withColumnRenamed("id", "k")

    def work(left):
        seen.append(left.count())
        return left.withColumn("score", F.col("k") * 2)

    assert sinks.resume(df.where("k < 4"), out, ["k"], work) == 4
    assert sinks.resume(df, out, ["k"], work) == 6
    assert sinks.resume(df, out, ["k"], work) == 0 and seen == [4, 6] and spark.read.parquet(out).count() == 10


def test_stream_of_scores_keeps_the_best(spark, tmp_path):
    columns, source = ["question_uid", "candidate_index", "rm"], str(tmp_path / "in")
    schema = "question_uid string, candidate_index bigint, rm double"
    for rows in ([("a", 0, 1.0), ("b", 0, 5.0)], [("a", 1, 3.0), ("b", 1, 5.0)], [("a", 2, 2.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    state = str(tmp_path / "state")
    q = stream.writeStream.foreachBatch(upsert.upsert(spark, state, columns)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(x.question_uid, x.candidate_index) for x in spark.read.parquet(f"{state}/version=2").collect()} == {("a", 1), ("b", 0)}
    assert upsert.windowed_counts(stream.withColumn("ts", F.current_timestamp()), "ts", "question_uid").isStreaming


def test_model_contracts(spark):
    from tallyforge.operators import models

    def small_memory():
        def score(texts):
            if len(texts) > 3:
                raise MemoryError
            return [float(len(t)) for t in texts]

        return score

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(20)], "k int, t string")
    assert {x.k: x.score for x in models.score_texts(df, "t", small_memory, 8).collect()} == {i: float(i) for i in range(20)}
    with pytest.raises(Exception, match="finite"):
        models.score_texts(df, "t", lambda: lambda texts: [float("nan")] * len(texts)).collect()
    head = models.TrajectoryHead(np.array([1.0, -1.0]), 0.0, (np.zeros((1, 5)), np.zeros(1), np.zeros(1), 0.0), (np.zeros((1, 5)), np.zeros(1), np.zeros(1), 0.0), (1.0, 2.0), (0.0, 1.0), (0.0, 1.0), 1.0)
    assert head.score(np.array([[1.0, 2.0]]), 3.0, 5) == {"score": 1.0, "trajectory": 0.0, "alpha": 1.0}
    got = head.score(np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]), 1.0, 5)
    assert got["alpha"] == 0.5 and got["trajectory"] == pytest.approx((4 * 0.5 + 0) / (1.0 + 1e-6), rel=1e-3) and got["score"] == pytest.approx(got["trajectory"] / 2)
    assert models.token_places([3, 8, 9], [(0, 3), (4, 8)]) == [0, 1, -1]
    q = spark.createDataFrame([(1, "p"), (2, "q")], "question_uid int, problem string")
    made = models.generate(q, lambda: lambda p, s: f"{p}{s % 2}", 8)
    again = models.recover(made, F.nullif(F.regexp_extract("solution_text", "([1])$", 1), F.lit("")), lambda: lambda p, s: f"{p}{s % 2}").collect()
    assert len(again) == 16 and all(x.solution_text.endswith("1") for x in again) and {x.stage for x in again} == {"primary", "recovery"}
    assert all((x.stage == "recovery") == x.primary_solution_text.endswith("0") for x in again)


def test_nll_stats_and_probes(spark):
    from tallyforge.operators import models

    v = [float(i * i % 7) for i in range(13)]
    x = spark.createDataFrame([(v,)], "v array<double>").select(models.nll_stats(F.col("v")).alias("x")).first().x
    assert tuple(x) == pytest.approx((np.mean(v), np.quantile(v, 0.9), max(v), np.mean(v[-8:]), np.std(v)))
    rng = np.random.default_rng(0)
    rows = [(k, q, int(y), [float(y if k else 0) + rng.normal() * 0.1, rng.normal()]) for k in range(2) for q in range(30) for y in (0, 1, 0, 1)]
    acc = {(r.layer, r.fold): r.accuracy for r in models.layer_probes(spark.createDataFrame(rows, "layer int, question_uid int, label int, v array<double>")).collect()}
    assert all(acc[1, f] > 0.99 for f in range(5)) and max(acc[0, f] for f in range(5)) < 0.9


def test_probes_count_all_held_out_pairs(spark, monkeypatch):
    from tallyforge.operators import models

    monkeypatch.setattr(models, "PROBE_SAMPLE", 1500)
    rng = np.random.default_rng(1)
    rows = [(0, q, i % 2, [float(i % 2 + round(rng.normal(), 1))]) for q in range(12) for i in range(200)]  # 10,000 pairs a question
    df = spark.createDataFrame(rows, "layer int, question_uid int, label int, v array<double>")
    fold = dict(df.select("question_uid", F.pmod(F.xxhash64(F.lit(1), "question_uid"), F.lit(5)).cast("int")).distinct().collect())
    wins, pairs = dict.fromkeys(range(5), 0), dict.fromkeys(range(5), 0)
    for q in range(12):
        p, n = (np.array([v[0] for _, x, y, v in rows if x == q and y == k]) for k in (1, 0))
        wins[fold[q]] += int((p[:, None] > n[None, :]).sum())
        pairs[fold[q]] += len(p) * len(n)
    got = {r.fold: r.accuracy for r in models.layer_probes(df).collect()}  # one dimension: any weight above 0 gives this order
    assert got == {k: wins[k] / n for k, n in pairs.items() if n}
