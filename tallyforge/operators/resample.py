"""Bootstrap over questions, by Poisson(1) counts from a hash of (seed, question, replicate).

Every question counts in every replicate as often as its hash says, so a replicate is the same in any order, on any partition
and at any size, and SQL says the same. Sums are made by replicate on the map side: what is shuffled is a row for each task and
replicate. A replicate has as many draws as there are questions on average.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws of one hash: sixteen of fifteen bits each.
DRAWS, BITS = 16, 15


def poisson_steps() -> list[int]:
    """A draw of BITS bits counts once for each of these that it reaches."""
    whole, total, out = 1 << BITS, 0.0, []
    for k in range(20):
        total += math.exp(-1) / math.factorial(k)
        if (step := round(whole * total)) < whole:
            out.append(step)
    return out


def bootstrap(records: DataFrame, means: list[str], ratios: dict[str, tuple[str, str]], samples: int, seed: int, by: tuple[str, ...] = (), key: str = "question_uid") -> DataFrame:
    """A row for each replicate (of each group of by): means of columns, NULLs left out, and ratios of sums (denominators of 1
    at least)."""
    columns = sorted({*means, *(c for r in ratios.values() for c in r)})
    rows = records.select(*by, F.col(key).cast("string").alias("k"), *columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS))))
    digits = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), "k", F.col("block").cast("string")), 256)
    quarter = F.array(*(F.conv(F.substring(digits, 16 * c + 1, 15), 16, 10).cast("bigint") for c in range(4)))
    rows = rows.select(*by, *columns, "block", F.posexplode(quarter).alias("c", "v"))
    draws = F.array(*(F.shiftright("v", BITS * d).bitwiseAND((1 << BITS) - 1) for d in range(4)))
    rows = rows.select(*by, *columns, "block", "c", F.posexplode(draws).alias("d", "u"))
    times = sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in poisson_steps()), F.lit(0))
    rows = rows.select(*by, *columns, (F.col("block") * DRAWS + F.col("c") * 4 + F.col("d")).cast("bigint").alias("sample"), times.alias("w")).where((F.col("w") > 0) & (F.col("sample") < samples))
    aggs = [F.try_divide(F.sum(F.col(x) * F.col("w")).cast("double"), F.sum(F.when(F.col(x).isNotNull(), F.col("w")))).alias(x) for x in means]
    aggs += [(F.sum(F.col(x) * F.col("w")).cast("double") / F.greatest(F.sum(F.col(y) * F.col("w")), F.lit(1))).alias(k) for k, (x, y) in ratios.items()]
    return rows.groupBy(*by, "sample").agg(*aggs)


def macro_bootstrap(records: DataFrame, dataset: str, means: list[str], ratios: dict[str, tuple[str, str]], samples: int, seed: int) -> DataFrame:
    """Data sets resampled each by itself; replicate b is the mean of their replicates b."""
    each = bootstrap(records, means, ratios, samples, seed, (dataset,))
    return each.groupBy("sample").agg(*[F.avg(c).alias(c) for c in [*means, *ratios]])


def interval(replicates: DataFrame, column: str) -> DataFrame:
    """2.5 and 97.5 percentiles, share above 0, and an add-one two-sided p."""
    low, high, n = F.count_if(F.col(column) <= 0), F.count_if(F.col(column) >= 0), F.count(column)
    p = F.least(F.lit(1.0), 2 * F.least((low + 1) / (n + 1), (high + 1) / (n + 1)))
    return replicates.agg(F.lit(column).alias("metric"), F.percentile(column, F.lit(0.025)).alias("lower"), F.percentile(column, F.lit(0.975)).alias("upper"), F.avg((F.col(column) > 0).cast("int")).alias("p_positive"), p.alias("p_two_sided"))


def group_noise(df: DataFrame, sigma: float, seed: int) -> DataFrame:
    """z(rm) of each question plus sigma times standard normal noise, by two hashed uniforms (Box-Muller): the same for a candidate
    in any run."""
    from .clusters import with_z

    z = with_z(df, "rm", "z", least=1e-12)

    def uniform(tag: str):
        h = F.sha2(F.concat_ws("|", F.lit(f"{seed}{tag}"), F.col("question_uid").cast("string"), F.col("candidate_index").cast("string")), 256)
        return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    return z.withColumn("noisy", F.col("z") + sigma * F.sqrt(-2 * F.ln(uniform("a"))) * F.cos(2 * np.pi * uniform("b")))


def _times(a: list[int], b: list[int], k: int) -> list[int]:
    """Product of two polynomials, given by their coefficients, up to x^k."""
    out = [0] * (k + 1)
    for i, x in enumerate(a):
        if x:
            for j, y in enumerate(b[: k + 1 - i]):
                out[i + j] += x * y
    return out


def _others(lost: list[list[int]], but: int, k: int) -> list[int]:
    """How many ways all clusters but one can have so many members in all, if each loses."""
    out = [1]
    for h, ways in enumerate(lost):
        if h != but:
            out = _times(out, ways, k)
    return out


def raw_share(clusters: list[list[int]], rm: list[float], label: list[int], k: int) -> int:
    """Number of k-subsets whose best candidate is right."""
    order = sorted((i for g in clusters for i in g), key=lambda i: (-rm[i], i))
    return sum(comb(len(order) - r - 1, k - 1) for r, i in enumerate(order) if label[i] == 1)


def majority_share(clusters: list[list[int]], rm: list[float], label: list[int], k: int) -> int:
    """Number of k-subsets whose largest cluster (then of the best reward, then of the first index) has a right best candidate. For each
    cluster, size, best reward and first index that it may win with, the others' losing subsets are counted by size, and the counts
    multiplied as polynomials; no subset is ever made."""
    total, shared = 0, Counter(rm[i] for g in clusters for i in g)
    for at, g in enumerate(clusters):
        for r in {rm[i] for i in g}:
            below, level = sum(rm[i] < r for i in g), sorted(i for i in g if rm[i] == r)
            # the first index of the subset matters only where another cluster may have the same best reward
            firsts = sorted(i for i in g if rm[i] <= r) if shared[r] > len(level) else [None]
            for m in range(1, min(k, len(g)) + 1):
                for first in firsts:
                    own = 0  # subsets of g of m members, best reward r, that first index, and a right best candidate (the first of reward r)
                    for n, t in enumerate(level):
                        if label[t] != 1:
                            continue
                        later = len(level) - n - 1
                        if first is None:
                            own += comb(below + later, m - 1)
                        elif t == first:
                            own += comb(sum(i > first for i in g if rm[i] < r) + later, m - 1)
                        elif t > first and rm[first] < r and m > 1:
                            own += comb(sum(i > first for i in g if rm[i] < r) + later, m - 2)
                    if not own:
                        continue
                    lost = []
                    for h in clusters:
                        less = sum(rm[i] < r for i in h)
                        tied = comb(less, m)
                        if first is not None:
                            behind = [rm[i] for i in h if i > first]
                            tied += comb(sum(x <= r for x in behind), m) - comb(sum(x < r for x in behind), m)
                        lost.append([comb(len(h), s) for s in range(m)] + [tied])
                    ways = _others(lost, at, k - m)
                    total += own * (ways[k - m] if len(ways) > k - m else 0)
    return total


def weighted_share(clusters: list[list[int]], rm: list[float], label: list[int], k: int, tau: float) -> int:
    """The same for the cluster of most mass, tau x log-sum-exp of rewards / tau (to nine places; then as before). The mass depends on
    the very members, so the subsets of each cluster are made, in order of their mass; those of different clusters never meet."""
    events = []
    for at, g in enumerate(clusters):
        for m in range(1, min(k, len(g)) + 1):
            for x in combinations(g, m):
                top = max(rm[i] for i in x) / tau
                mass = tau * (top + math.log(sum(math.exp(rm[i] / tau - top) for i in x)))
                events.append((round(mass, 9), max(rm[i] for i in x), -min(x), at, m, label[max(x, key=lambda i: (rm[i], -i))]))
    total, lost, known = 0, [[1] + [0] * k for _ in clusters], {}
    for *_, at, m, right in sorted(events):
        if right == 1:
            ways = known.get(at) or known.setdefault(at, _others(lost, at, k - 1))
            total += ways[k - m] if len(ways) > k - m else 0
        lost[at][m] += 1
        known = {at: known[at]} if at in known else {}  # what the others can lose with has grown, but not for this cluster
    return total


def exact_subsets(cand: DataFrame, k: int, tau: float = 4.0, largest: int = 16) -> DataFrame:
    """Share of a question's k-subsets in which each rule picks a right candidate, for questions of k candidates or more: counted by
    cluster, not by subset (raw and majority at any size). weighted is null where a cluster has more than largest candidates: its
    subsets are as many as two to that power."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows in b.column("c").to_pylist():
                groups: dict = {}
                for i, x in enumerate(rows):
                    groups.setdefault(x["answer"] if x["answer"] is not None else ("", i), []).append(i)
                own, every = (list(groups.values()), [x["rm"] for x in rows], [x["label"] for x in rows], k), comb(len(rows), k)
                weighted = weighted_share(*own, tau) / every if max(map(len, own[0])) <= largest else None
                out.append((raw_share(*own) / every, majority_share(*own) / every, weighted))
            yield pa.RecordBatch.from_arrays([b.column("question_uid"), *[pa.array([x[i] for x in out], pa.float64()) for i in range(3)]], names=["question_uid", "raw", "majority", "weighted"])

    kind = cand.schema["question_uid"].dataType.simpleString()
    one = F.struct("candidate_index", "answer", F.col("rm").cast("double").alias("rm"), "label")
    rows = cand.groupBy("question_uid").agg(F.array_sort(F.collect_list(one)).alias("c")).where(F.size("c") >= k)
    return rows.mapInArrow(run, f"question_uid {kind}, raw double, majority double, weighted double")
