"""Centroid clustering (Lloyd's rounds) on exact integers, with exponion search.

Every vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to any other. When
centroids move, the bounds move with them. A vector whose upper bound stays below its lower bound, or below half the way from
its centroid to the next one, keeps its centroid without a look at any. For the others the upper bound is made exact; then only
centroids inside the ball of radius 2 u + s around the vector's centroid are compared (u: upper bound, s: distance to the next
centroid), a prefix of the sorted list of distances between centroids. The radius is inclusive and a bound must be passed
strictly, so that ties are seen; they go to the smaller number. Distances are exact integers; only the bounds are doubles, and
these are rounded away from the truth.

Plan: vectors with their bounds are a table in the shared folder, written anew each round (the one before goes), so that a lost
executor costs part of a round. Sums are kept by difference: only vectors that changed their centroid are read again, each task
gives a row of limbs for each (centroid, component), and Spark adds them. The driver holds k x dims numbers and sums of these.

Cases: a vector that is null, has another number of components, or has a null or non-finite one takes no part, nor has one
with a scaled component of 2^180 or more (no float column holds one). Fewer vectors than k: as many centroids as vectors. No vectors: no rows.
Rows that repeat an id are vectors each. A null id is answered, but doesn't become a starting centroid (if all ids are null,
there is none, and no rows). Equal hashes: smaller id, then smaller components. A squared distance or a sum of them beyond
64 bits is null; the search stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds are rounded away from the truth by this share; doubles err by a thousandth of it over hundreds of rounds.
_SLACK = 1e-12
#: Sums cross from tasks as signed top and three lower limbs of so many bits: exact for any double's size up to 2^170.
_LIMB = 48
_LIMBS = 4
_INT64 = 2**63 - 1


def exact_width(dims: int) -> float:
    """Integers below this in size have squared distances over dims components that doubles hold exactly, term by term."""
    return float(2 ** int((53 - np.log2(max(dims, 1)) - 2) // 2))


def _whole(v: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return v if v.dtype == object else np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


class Centroids:
    """k centroids of integers, the distances between them in order (k x k numbers), and how far they came."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.dims, self.k = len(rows[0]), len(rows)
        small = all(abs(x) < exact_width(self.dims) for r in rows for x in r)
        self.matrix = np.array(rows, float if small else object)
        between = np.sqrt(np.stack([self.squares(self.matrix[i : i + 1])[0] for i in range(self.k)]).astype(float))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, 1) * (1 - _SLACK)  # a shorter way is never left out
        self.next = np.where(np.eye(self.k, dtype=bool), np.inf, between).min(1)
        self.drift = self.others = np.zeros(self.k)
        if before is not None:
            self.drift = np.array([float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(rows, before, strict=True)]) * (1 + _SLACK)
            *_, second, most = [0.0, *np.sort(self.drift)]
            self.others = np.where(self.drift == most, second, most)

    def squares(self, v: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of each row of v to the centroids numbered in to (all): doubles that are integers, or integers."""
        c = self.matrix if to is None else self.matrix[to]
        if v.dtype == object or c.dtype == object:
            return np.stack([((_whole(v) - x) ** 2).sum(1) for x in _whole(c)], 1)
        return (v * v).sum(1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(1)

    def own(self, v: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Squared distance of each row of v to the centroid numbered in a."""
        c = self.matrix[a]
        d = _whole(v) - _whole(c) if v.dtype == object or c.dtype == object else v - c
        return (d * d).sum(1)

    def search(self, v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> int:
        """Nearest centroids of the rows of v, in place: a (-1: none yet), u and low. Gives the number of distances computed."""
        fresh, seen = a < 0, 0
        u[~fresh] += self.drift[a[~fresh]]
        low[~fresh] -= self.others[a[~fresh]]
        half = 0.5 * (1 - _SLACK) * self.next
        todo = np.flatnonzero(fresh | ~(u < np.maximum(low, half[a])))
        again = todo[~fresh[todo]]
        if len(again):
            u[again] = np.sqrt(self.own(v[again], a[again]).astype(float)) * (1 + _SLACK)
            seen += len(again)
            todo = np.concatenate((todo[fresh[todo]], again[~(u[again] < np.maximum(low[again], half[a[again]]))]))
        ball = np.full(len(todo), self.k)
        for j in np.unique(a[todo]):
            if j >= 0:
                at = a[todo] == j
                ball[at] = np.searchsorted(self.sorted[j], (2 * u[todo[at]] + self.next[j]) * (1 + _SLACK), "right")
        # annuli double, so that a few products of matrices serve all radii; at least two, for the second nearest
        level = np.minimum(2 ** np.ceil(np.log2(np.maximum(ball, 2))).astype(int), self.k)
        centre = np.where(a[todo] < 0, 0, a[todo])
        for j, m in {(int(x), int(y)) for x, y in zip(centre, level, strict=True)}:
            at = todo[(centre == j) & (level == m)]
            to = np.sort(self.order[j][:m])  # by number, so that argmin takes the smallest of equals
            d = self.squares(v[at], to)
            seen += d.size
            best = d.argmin(1)
            row = np.arange(len(at))
            a[at], u[at] = to[best], np.sqrt(d[row, best].astype(float)) * (1 + _SLACK)
            if m > 1:
                d = d.astype(float)
                d[row, best] = np.inf
                low[at] = np.sqrt(d.min(1)) * (1 - _SLACK)
            else:
                low[at] = np.inf
        return seen


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of whole doubles; as Python integers if some are too large for exact doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return _whole(flat) if len(flat) and np.abs(flat).max() >= exact_width(dims) else flat


def usable(vector: str, dims: int, scale: float) -> Column:
    """floor(scale * x) of every component x as doubles; null if the vector takes no part."""
    scaled = F.transform(F.col(vector), lambda x: F.lit(scale) * x.cast("double"))
    fine = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < F.lit(2.0**180), F.lit(False)))  # NaN is larger than any number
    return F.when((F.size(vector) == dims) & fine, F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)))


def starting(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors (id, v) whose id has the smallest hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where(F.col("id").isNotNull()).select(h.alias("h"), "id", "v").orderBy("h", "id", "v").limit(k).collect()  # k rows
    return [[int(x) for x in r.v] for r in first]


def _assigned(table: DataFrame, now: Centroids, last: bool) -> DataFrame:
    """Every vector's next centroid and bounds; was: the one before. In the last round also its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for b in batches:
            v = _vectors(b.column("v"), now.dims)
            was = b.column("a").to_numpy()
            a, u, low = was.copy(), b.column("u").to_numpy().copy(), b.column("low").to_numpy().copy()
            now.search(v, a, u, low)
            columns = {"id": b.column("id"), "v": b.column("v"), "a": pa.array(a), "was": pa.array(was), "u": pa.array(u), "low": pa.array(low)}
            if last:
                d = now.own(v, a)
                columns["distance"] = pa.array([int(x) if x <= _INT64 else None for x in d] if d.dtype == object else d.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kind, shared = table.schema["id"].dataType.simpleString(), table.sparkSession.sparkContext.broadcast(now)
    return table.select("id", "v", "a", "u", "low").mapInArrow(run, f"id {kind}, v array<double>, a int, was int, u double, low double" + ", distance bigint" * last)


def _moved(table: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int]]:
    """What the sums and numbers of vectors of each centroid change by, since the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * dims for _ in range(k)], [0] * k
        for b in batches:
            v = _vectors(b.column("v"), dims)
            for column, sign in (("a", 1), ("was", -1)):
                at = b.column(column).to_numpy()
                for j in np.unique(at[at >= 0]):
                    own = v[at == j]
                    counts[j] += sign * len(own)
                    total = own.sum(0) if own.dtype == object else own.astype(np.int64).sum(0)
                    sums[j] = [x + sign * int(y) for x, y in zip(sums[j], total, strict=True)]
        rows = [(j, i, x) for j in range(k) if counts[j] or any(sums[j]) for i, x in enumerate([*sums[j], counts[j]])]
        limbs = [[x >> (_LIMB * n) if n == _LIMBS - 1 else (x >> (_LIMB * n)) & ((1 << _LIMB) - 1) for n in range(_LIMBS)] for *_, x in rows]
        yield pa.RecordBatch.from_pydict({"j": pa.array([r[0] for r in rows], pa.int32()), "i": pa.array([r[1] for r in rows], pa.int32())} | {f"l{n}": pa.array([x[n] for x in limbs], pa.int64()) for n in range(_LIMBS)})

    names = [f"l{n}" for n in range(_LIMBS)]
    parts = table.where("a != was").select("v", "a", "was").mapInArrow(run, "j int, i int, " + ", ".join(f"{x} bigint" for x in names))
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for r in parts.groupBy("j", "i").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in names]).collect():  # k x (dims + 1) rows
        x = sum(int(r[f"l{n}"]) << (_LIMB * n) for n in range(_LIMBS))
        if r.i == dims:
            counts[r.j] = x
        else:
            sums[r.j][r.i] = x
    return sums, counts


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: float = 1024.0, seed: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(id, v, cluster, distance) of every vector that takes part (v: its integers, distance: squared), and the centroids."""
    spark = df.sparkSession
    common.ship(spark)
    table = df.select(F.col(id).alias("id"), usable(vector, dims, scale).alias("v"), F.lit(-1).alias("a"), F.lit(float("inf")).alias("u"), F.lit(0.0).alias("low")).where(F.col("v").isNotNull())
    table = common.kept(table, "vectors", place := common.scratch(spark, "vectors"))
    rows = starting(table, k, seed)
    if not rows:
        return table.where("false").select("id", "v", F.col("a").alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    sums, counts, before = [[0] * dims for _ in rows], [0] * len(rows), None
    for n in range(rounds + 1):
        old, place = place, common.scratch(spark, "vectors")
        table = common.kept(_assigned(table, Centroids(rows, before), n == rounds), "vectors", place)
        common.drop_scratch(spark, old)
        if n < rounds:
            plus, more = _moved(table, len(rows), dims)
            sums = [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(sums, plus, strict=True)]
            counts = [x + y for x, y in zip(counts, more, strict=True)]
            before, rows = rows, [[x // c for x in s] if c else r for s, c, r in zip(sums, counts, rows, strict=True)]
    return table.select("id", "v", F.col("a").alias("cluster"), "distance"), rows


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, rows = cluster(common.read(spark, sf_dir, "embeddings"))
    sha = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = found.groupBy("cluster").agg(total.alias("d")).collect()  # a row for each centroid
    total = None if any(r.d is None for r in each) else sum(int(r.d) for r in each)
    per = [(r.cluster, None if r.d is None or r.d > _INT64 else int(r.d), total if total is not None and total <= _INT64 else None, sha[r.cluster]) for r in each]
    known = F.broadcast(spark.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return found.join(known, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """Plain Lloyd rounds, each a pair of tables."""
    steps = [f"""
x AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS j, v AS c
  FROM (SELECT sha256('3:' || vec_id) AS h, vec_id, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, vec_id, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT i, vec_id, v, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place
  FROM (SELECT i, vec_id, v, j, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda p: (v[p] - c[p]) * (v[p] - c[p]))) AS BIGINT) AS d FROM x CROSS JOIN c{n})) WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c
  FROM (SELECT j, p, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS y, unnest(range(1, {dims + 1})) AS p FROM a{n}) GROUP BY j, p) GROUP BY j) m ON c.j = m.j)""")
    return "WITH " + ",".join(steps) + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""


OP13_SQL = _sql()
