"""Quantiles, ranks and correlations by counted values, against sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import stats


def rows(seed=0, n=900):
    r = np.random.default_rng(seed)
    g = r.choice(["a", "b", None, "one"], n, p=[0.6, 0.2, 0.19, 0.01]).tolist()
    x = [None if r.random() < 0.05 else float(np.round(r.standard_normal(), 1)) if k == "a" else float(r.standard_normal()) for k in g]
    y = [None if r.random() < 0.05 else float(np.round((v or 0) + r.standard_normal(), 1)) for v in x]
    return [*zip(g, x, y, strict=True), ("void", None, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "g string, x double, y double").repartition(5)


def groups():
    p = pd.DataFrame(rows(), columns=["g", "x", "y"])
    return {k if isinstance(k, str) else None: v for k, v in p.groupby("g", dropna=False)}


def test_describe_and_quartiles(df):
    for r in stats.describe(df, "x", "g").collect():
        x = groups()[r.g]["x"].dropna()
        if not len(x):
            assert (r.n, r.median, r.kinds) == (0, None, 0)
            continue
        want = (len(x), x.min(), x.quantile(0.05), x.median(), x.mean(), x.quantile(0.95), x.max(), x.std(ddof=0), x.nunique())
        assert tuple(r)[1:] == pytest.approx(want, abs=1e-12)
    got = stats.quartiles(df, "x").first()
    x = pd.concat(g["x"] for g in groups().values()).dropna()
    assert tuple(got) == pytest.approx((len(x), *x.quantile([0, 0.25, 0.5, 0.75, 1])), abs=1e-12)
    assert stats.quartiles(df.where("false"), "x").first().n == 0 and stats.describe(df.where("false"), "x", "g").collect() == []


@pytest.mark.parametrize("q", [0.0, 0.37, 0.9, 1.0])
def test_nearest_rank(df, q):
    got = {r.g: r.value for r in stats.nearest_rank(df, "x", q, "g").collect()}
    want = {k: sorted(g["x"].dropna())[round((g["x"].notna().sum() - 1) * q)] for k, g in groups().items() if g["x"].notna().any()}
    assert got == want


def test_correlations(df):
    for r in stats.correlations(df, "x", "y", "g").collect():
        p = groups()[r.g].dropna(subset=["x", "y"])
        assert r.n == len(p)
        if p["x"].nunique() > 1 and p["y"].nunique() > 1:
            assert (r.pearson, r.spearman) == pytest.approx((p["x"].corr(p["y"]), p["x"].rank().corr(p["y"].rank())), abs=1e-9)
        else:
            assert (r.pearson, r.spearman) == (None, None)


def test_a_hot_group_fills_many_parts(spark):
    """A group with nearly all rows is no task of its own: its values lie in many parts, of like size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40000).select(F.when(F.col("id") < 39900, "hot").otherwise("cold").alias("g"), F.xxhash64("id").cast("double").alias("x"))
        places = stats.value_places(df, "x", "g")
        sizes = sorted(r["count"] for r in places.where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) >= 4 and sizes[-1] < 0.6 * 39900
        assert places.where("below < 0 OR below + n > total").count() == 0 and places.where("g = 'hot'").agg(F.count_distinct("below").alias("n")).first().n == 39900
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
