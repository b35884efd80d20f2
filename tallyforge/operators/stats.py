"""Descriptive statistics, correlation, trends and mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch


def _same(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a with the columns of b of the same group; null is a group, and without by all rows are one."""
    own = b.withColumnsRenamed({c: f"__of_{c}" for c in by})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    return (a.join(own, on, how) if by else a.join(F.broadcast(own), on, how)).drop(*[f"__of_{c}" for c in by])


def value_places(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Each distinct value of x that isn't null, by group: how many rows have it (n), how many of the group are below (below) and how many
    the group has (total). Values are counted, then put in order by ranges of (group, value), so that a group of any size is spread
    over as many ranges as it fills; no task or buffer holds a group."""
    spark, at = df.sparkSession, scratch.path(df.sparkSession, "values")
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    values.repartitionByRange(*by, x).withColumn("part", F.spark_partition_id()).write.parquet(at)  # so that parts stay as they are
    cut = spark.read.parquet(at)
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    parts = cut.groupBy("part", *by).agg(F.sum("n").alias("own"))
    starts = parts.select("part", *by, F.sum("own").over(group).alias("total"), (F.sum("own").over(group.orderBy("part")) - F.col("own")).alias("start"))  # a row for each part and group
    inside = F.sum("n").over(Window.partitionBy("part", *by).orderBy(x)) - F.col("n")
    found = _same(cut.withColumn("inside", inside), starts, ("part", *by))
    return found.select(*by, x, "n", (F.col("start") + F.col("inside")).alias("below"), "total")


def quantiles(df: DataFrame, x: str, wanted: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles of each group, linear between the two nearest values."""
    rows, aggs, out = value_places(df, x, *by), [], []
    for name, q in wanted.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(x))).alias(f"{end}_{name}"))
        at = (F.col("__total") - 1) * F.lit(float(q))
        out.append((F.col(f"lo_{name}") + (at - F.floor(at)) * (F.col(f"hi_{name}") - F.col(f"lo_{name}"))).alias(name))
    got = rows.groupBy(*by).agg(F.max("total").alias("__total"), F.count("*").alias("__kinds"), *aggs)
    return got.select(*by, *out, F.col("__kinds").alias("kinds"))


def describe(df: DataFrame, x: str, *by: str) -> DataFrame:
    own = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.max(x).alias("most"), F.stddev_pop(x).alias("sd"))
    got = _same(own, quantiles(df, x, {"p05": 0.05, "median": 0.5, "p95": 0.95}, *by), by, "left")
    return got.select(*by, "n", "least", "p05", "median", "mean", "p95", "most", "sd", F.coalesce("kinds", F.lit(0)).cast("bigint").alias("kinds"))


def quartiles(df: DataFrame, x: str, *by: str) -> DataFrame:
    own = df.groupBy(*by).agg(F.count(x).alias("n"))
    return _same(own, quantiles(df, x, {f"q{int(q * 100)}": q for q in (0.0, 0.25, 0.5, 0.75, 1.0)}, *by), by, "left").drop("kinds")


def nearest_rank(df: DataFrame, x: str, q: float, *by: str) -> DataFrame:
    """The value at place round((n - 1) q), half to even, of the sorted values."""
    at = F.bround((F.col("total") - 1) * q, 0).cast("bigint")
    return value_places(df, x, *by).where((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*by, F.col(x).alias("value"))


def average_rank(x: str, *by: str) -> tuple[Column, Column]:
    """Rank, and how many share it: the average rank is rank + (shared - 1) / 2."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)), F.count("*").over(Window.partitionBy(*by, x))


def with_average_ranks(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    for c in columns:
        a, b = average_rank(c, *by)
        df = df.withColumn(f"rank_{c}", a + (b - 1) / 2)
    return df


#: Tasks among which the rows of one value are dealt.
SALTS = 8


def correlations(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson and Spearman of each group; NULL where a side doesn't vary. Ranks come from ``value_places``: equal pairs of values are
    counted first, and meet the rank of either value."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = df.groupBy(*by, x, y).agg(F.count("*").alias("__m"))
    for i, (c, other) in enumerate(((x, y), (y, x))):
        ranks = value_places(df, c, *by).select(*by, c, (F.col("below") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"__r{i}"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        pairs = _same(pairs.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")), ranks, (*by, c, "__salt")).drop("__salt")
    m, a, b = F.col("__m"), F.col("__r0"), F.col("__r1")
    ranked = pairs.groupBy(*by).agg(F.try_divide(F.sum(m * a * b), F.sqrt(F.sum(m * a * a)) * F.sqrt(F.sum(m * b * b))).alias("spearman"), (F.sum(m * a * a) > 0).alias("__x"), (F.sum(m * b * b) > 0).alias("__y"))
    own = df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("pearson"))
    varies = F.col("__x") & F.col("__y")
    return _same(own, ranked, by).select(*by, "n", F.when(varies, F.col("pearson")).alias("pearson"), F.when(varies, F.col("spearman")).alias("spearman"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def leave_one_out(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Pearson without each key in turn, from sums: total less own, so no row meets another."""
    sums = {"n": F.lit(1), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) ** 2, "syy": F.col(y) ** 2, "sxy": F.col(x) * F.col(y)}
    own = df.groupBy(key).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    total = own.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    j = own.crossJoin(F.broadcast(total)).select(key, *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in sums])
    a, b = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return j.select(key, F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(a * b)).alias("pearson"))


def mixture(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Mean and deviation of an equal mixture of the data sets, by second moments."""
    per = df.groupBy(dataset).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.avg(F.col(c) ** 2).alias(f"s_{c}") for c in columns])
    means = per.agg(*[F.avg(f"m_{c}").alias(f"{c}_mean") for c in columns], *[F.avg(f"s_{c}").alias(f"s_{c}") for c in columns])
    return means.select(*[f"{c}_mean" for c in columns], *[F.sqrt(F.greatest(F.col(f"s_{c}") - F.col(f"{c}_mean") ** 2, F.lit(0.0))).alias(f"{c}_std") for c in columns])


def monotone(df: DataFrame, order: str, x: str) -> DataFrame:
    """Whether x rises, or falls, strictly along the order. df has a row for each step, so it is small."""
    d = df.withColumn("d", F.col(x) - F.lag(x).over(Window.orderBy(order)))
    return d.agg(F.bool_and(F.col("d") > 0).alias("rising"), F.bool_and(F.col("d") < 0).alias("falling"))


def by_level(df: DataFrame, level: str, x: str) -> DataFrame:
    return df.groupBy(level).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))


def reproduction_error(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.withColumn("__d", F.abs(F.col(x) - F.col(y)))
    d = F.col("__d")
    own = rows.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.avg(d).alias("mae"), F.max(d).alias("max_ae"), F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("sign_agreement"), F.avg((d == 0).cast("int")).alias("exact"))
    return _same(own, quantiles(rows, "__d", {"median_ae": 0.5}), (), "left").select("n", "pearson", "mae", "median_ae", "max_ae", "sign_agreement", "exact")


def standard_error(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Of fold means: sample deviation over the root of their number."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))


def population(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
