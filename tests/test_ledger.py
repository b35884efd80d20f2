"""Parts that a restart checks: lost, cut, doubled, changed, of other settings; on a path that only Spark can open."""

import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import ledger, sinks

KEYS = ["q", "i"]


@pytest.fixture
def at(spark, tmp_path):
    """A folder by another name, which open() doesn't know."""
    name = f"t{uuid.uuid4().hex}"  # a table of its own, since file systems are kept
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./parts", f"file://{tmp_path}")
    return f"viewfs://{name}/parts/run", str(tmp_path / "run")


def rows(spark, n=200):
    return spark.createDataFrame([(None if k == 7 else f"q{k // 4}", k % 4, f"text {k}") for k in range(n)], "q string, i int, t string")


def work(df):
    return df.withColumn("score", F.length("t").cast("double"))


def test_only_what_is_wrong_is_done_again(spark, at):
    where, local = at
    df, settings = rows(spark), {"model": "m", "k": 4}
    assert set(ledger.run_parts(df, where, KEYS, work, 10, settings, 3).values()) == {"missing"}
    assert ledger.run_parts(df, where, KEYS, work, 10, settings) == {}
    shutil.rmtree(f"{local}/part-000001")
    cut = [f for f in os.listdir(f"{local}/part-000002") if f.endswith(".parquet")]
    spark.read.parquet(f"{local}/part-000002").limit(1).write.mode("overwrite").parquet(f"{local}/other")
    for f in cut:
        os.remove(f"{local}/part-000002/{f}")
    shutil.copy(next(f"{local}/other/{f}" for f in os.listdir(f"{local}/other") if f.endswith(".parquet")), f"{local}/part-000002/one.parquet")
    for f in [f for f in os.listdir(f"{local}/part-000003") if f.endswith(".parquet")]:
        shutil.copy(f"{local}/part-000003/{f}", f"{local}/part-000003/again-{f}")
    for f in [f for f in os.listdir(f"{local}/part-000004") if f.endswith(".parquet")]:
        with open(f"{local}/part-000004/{f}", "wb") as x:
            x.write(b"no parquet")
    os.remove(f"{local}/ledger/000005.json")
    with open(f"{local}/ledger/000006.json", "w") as x:
        x.write('{"rows": 1')
    before = {p: os.stat(f"{local}/part-{p:06d}").st_ino for p in (0, 7, 8, 9)}
    assert ledger.run_parts(df, where, KEYS, work, 10, settings) == {1: "lost", 2: "cut", 3: "doubled", 4: "lost", 5: "missing", 6: "missing"}
    assert {p: os.stat(f"{local}/part-{p:06d}").st_ino for p in before} == before
    got = sorted((str(r.q), r.i, r.t, r.score) for r in ledger.read_parts(spark, where).collect())
    assert got == sorted((str(r.q), r.i, r.t, float(len(r.t))) for r in df.collect())


def test_more_rows_and_other_settings(spark, at):
    where, _ = at
    ledger.run_parts(rows(spark, 100), where, KEYS, work, 5, {"k": 4})
    grown = ledger.run_parts(rows(spark, 104), where, KEYS, work, 5, {"k": 4})
    assert grown and set(grown.values()) == {"cut"}  # parts that more rows belong to
    assert ledger.read_parts(spark, where).count() == 104
    assert set(ledger.run_parts(rows(spark, 104), where, KEYS, work, 5, {"k": 5}).values()) == {"other settings"}


def test_a_stopped_job_leaves_whole_parts(spark, at):
    where, _ = at
    calls = []

    def stops(df):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return work(df)

    with pytest.raises(KeyboardInterrupt):
        ledger.run_parts(rows(spark), where, KEYS, stops, 8, {}, 2)
    left = ledger.run_parts(rows(spark), where, KEYS, work, 8, {}, 2)
    assert len(left) == 4 and ledger.read_parts(spark, where).count() == 200


def test_work_keeps_the_rows(spark, at):
    where, _ = at
    for bad in (lambda d: d.limit(3), lambda d: d.unionByName(d), lambda d: d.withColumn("i", F.col("i") + 1)):
        with pytest.raises(ValueError, match="lost, added or changed"):
            ledger.run_parts(rows(spark, 20), where, KEYS, bad, 1, {})
    assert ledger.run_parts(rows(spark, 20).where("false"), where, KEYS, work, 3, {}) == {}


def test_small_files_appear_at_once(spark, at):
    where, local = at
    h = sinks.publish(spark, f"{where}/deep/a.txt", "ünï\n")
    assert sinks.stored(spark, f"{where}/deep/a.txt") == "ünï\n" and sinks.stored(spark, f"{where}/none") is None
    with pytest.raises(FileExistsError):
        sinks.publish(spark, f"{where}/deep/a.txt", "other")
    assert sinks.publish(spark, f"{where}/deep/a.txt", "other", True) != h and os.listdir(f"{local}/deep") in (["a.txt"], ["a.txt", ".a.txt.crc"], [".a.txt.crc", "a.txt"])
