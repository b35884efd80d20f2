"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are dealt to the lists of k-means centres (fitted on at most ``SAMPLE`` vectors; every vector is indexed). The k-th
distance from a query to the last ``FIRST`` vectors of the sample bounds its true k-th distance from the start, and these vectors are candidates. A query probes its nearest lists:
as many as hold the share ``cover`` of the nearest in a quarter of the sample that the centres aren't fitted on, measured by
brute force there (these are about as far as the k-th nearest of all, so the k nearest are found more often), less those that the triangle
inequality (distance to the centre less the list's radius) puts beyond the bound.

A list is scanned in blocks of dimensions of randomly rotated vectors: after d of D dimensions a candidate is given up when
its partial squared distance times D/d exceeds the query's present k-th distance by the factor (1 + eps/sqrt(d))^2, a test
that a true neighbour fails with small probability, as a random rotation spreads distance evenly. What survives all blocks is
measured exactly, on the original vectors in double precision.

Neighbouring lists share a cell of about ``CHUNK`` vectors, and a query goes to a cell once for all of its lists there. The
vectors of a larger cell are dealt by a hash to chunks, the queries that probe a cell to blocks of about ``QUERIES``, and each
chunk meets each block in a group of its own, so no list has to fit one task. Every group gives k candidates for a query, and
a window merges them. Centres, rotation, sample and list sizes are bounded by ``LISTS`` and ``SAMPLE`` and are broadcast;
vectors and queries are shuffled.

Cases: vectors that are null, all zero, of another length than most, or with a null or non-finite component take no part;
with k candidates or fewer all are returned; equal distances go to the smaller id; of rows that repeat an id the one with the
least vector (by components, in order) counts, and it asks if one of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE = 20_000
#: Vectors of the sample that every query is compared with, for a first bound.
FIRST = 1024
LISTS = 4096
#: Vectors of a list, as far as LISTS allows.
PER_LIST = 12
CHUNK = 8192
QUERIES = 32_768
#: Queries and vectors that are compared at once.
ROWS, BLOCK = 256, 4096


def usable(vector: str) -> Column:
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if k > 1 else 1):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        order = np.argsort(of, kind="stable")
        some = np.flatnonzero(n)
        total = np.zeros_like(centres)
        total[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some])
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, cover: float, n: int, asked: int = 1000) -> int:
    """How many of a vector's nearest lists hold the share cover of its nearest others, measured by brute force in the sample:
    of so many of these as lie, among all n rows, within the distance of the k nearest."""
    k = max(1, -(-k * len(sample) // max(n, len(sample))))
    if len(sample) <= k + 1 or len(centres) < 2:
        return len(centres)
    of, places = nearest(sample, centres), []
    for lo in range(0, min(asked, len(sample)), 200):
        q = sample[lo : min(lo + 200, asked)]
        d = distances(q, sample)
        d[np.arange(len(q)), lo + np.arange(len(q))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        rank = np.argsort(np.argsort(distances(q, centres), 1, kind="stable"), 1, kind="stable")
        places.append(np.take_along_axis(rank, of[near], 1).ravel())
    return int(np.ceil(np.quantile(np.concatenate(places), cover))) + 1


def in_sample(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each x the k nearest others of the sample, or all: ids and distances, -1 and infinite where there is none. The last
    of k distances is a bound: the k-th nearest of all vectors is no farther."""
    k_ = min(k, len(sample))
    near, dist = np.full((len(x), k), -1, np.int64), np.full((len(x), k), np.inf)
    for lo in range(0, len(x) if k_ else 0, ROWS):
        own = slice(lo, min(lo + ROWS, len(x)))
        d = distances(x[own], sample)
        d[ids[own, None] == sample_ids] = np.inf
        at = np.argpartition(d, k_ - 1, 1)[:, :k_]
        exact = np.where(np.isfinite(np.take_along_axis(d, at, 1)), np.sqrt(((sample[at] - x[own, None]) ** 2).sum(2)), np.inf)
        near[own, :k_], dist[own, :k_] = np.where(np.isfinite(exact), sample_ids[at], -1), exact
    return near, dist


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(ids: np.ndarray, x: np.ndarray, of: np.ndarray, query_ids: np.ndarray, q: np.ndarray, limit: np.ndarray, probed: np.ndarray, turn: np.ndarray, k: int, step: int = 16, eps: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors x of the lists that each query probes (probed: queries by lists; of: a vector's list), its k nearest
    within limit, by the adaptive scan: number of the query, id and exact distance."""
    d = x.shape[1]
    xt, qt = x @ turn, q @ turn
    edges = [*range(0, d, step), d]
    slack = 1e-11 * ((q * q).sum(1) + (x * x).sum(1).max())
    found_q, found_id, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for top in range(0, len(q), ROWS):
        own = np.arange(top, min(top + ROWS, len(q)))
        most = limit[own] ** 2
        best_q, best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, len(x), BLOCK):
            hi = min(lo + BLOCK, len(x))
            live = probed[own][:, of[lo:hi]] & (query_ids[own, None] != ids[lo:hi])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if not a:  # the first block of all pairs at once, later ones for what is left
                    part = distances(qt[own, :b], xt[lo:hi, :b])
                else:
                    diff = xt[lo + xi, a:b] - qt[top + qi, a:b]
                    part += (diff * diff).sum(1)
                room = most if b == d else most * (1 + eps / np.sqrt(b)) ** 2 * (b / d)
                room = room * (1 + 1e-9) + slack[own]
                if not a:
                    qi, xi = np.nonzero(live & (part <= room[:, None]))
                    part = part[qi, xi]
                else:
                    stay = part <= room[qi]
                    qi, xi, part = qi[stay], xi[stay], part[stay]
                if not len(qi):
                    break
            if not len(qi):
                continue
            exact = np.sqrt(((x[lo + xi] - q[top + qi]) ** 2).sum(1))
            best_q, best_id, best = np.concatenate((best_q, qi)), np.concatenate((best_id, ids[lo + xi])), np.concatenate((best, exact))
            order = np.lexsort((best_id, best, best_q))
            best_q, best_id, best = best_q[order], best_id[order], best[order]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            most[best_q[place == k - 1]] = np.minimum(most[best_q[place == k - 1]], best[place == k - 1] ** 2)
            best_q, best_id, best = best_q[place < k], best_id[place < k], best[place < k]
        found_q, found_id, found = np.concatenate((found_q, top + best_q)), np.concatenate((found_id, best_id)), np.concatenate((found, best))
    return found_q, found_id, found


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _once(rows: DataFrame) -> DataFrame:
    """Each vec_id once: where rows repeat one, that with the least vector."""
    twice = rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    if twice.isEmpty():  # vectors needn't move for it
        return rows
    one = rows.join(twice, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(one)


def search(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", cover: float = 0.9) -> DataFrame:
    """query_id, rank, vec_id, score and n_scanned (vectors of the lists that the query probes): for each row that queries
    holds for, its k nearest others."""
    spark = df.sparkSession
    common.ship(spark)
    rows = df.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, n_scanned bigint")
    d, n = sizes[0]
    rows = _once(rows.where(F.size("v") == d))
    share = min(1.0, 1.2 * SAMPLE / n + 100 / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE)
    drawn = drawn.select("vec_id", "v").toArrow()
    sample_ids, sample = drawn.column("vec_id").to_numpy(), np.array(drawn.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d)
    held = len(sample) // 4  # these calibrate: centres lie too near to what they are fitted on
    centres = kmeans(sample[held:], int(min(LISTS, max(1, n // PER_LIST), max(1, len(sample) // 4)))) if len(sample) else sample
    probes = probes_for(sample[:held], centres, k, cover, n)
    shared = spark.sparkContext.broadcast((centres, rotation(d), sample_ids[-FIRST:], sample[-FIRST:]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, d)
            of = nearest(x, shared.value[0])
            far = np.sqrt(((x - shared.value[0][of]) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": pa.array([v.tobytes() for v in x], pa.binary()), "asks": b.column("asks"), "list": pa.array(of.astype(np.int32)), "far": pa.array(far)})

    have = common.kept(rows.mapInArrow(listed, "vec_id bigint, v binary, asks boolean, list int, far double"), "ann-lists")
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for x in have.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each list
        count[x["list"]], radius[x["list"]] = x["n"], x["far"]
    cell_of = nearest(centres, kmeans(centres, max(1, min(len(centres), round(int(count.sum()) / CHUNK)))))
    lists = spark.sparkContext.broadcast((count, radius, cell_of))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, sample_ids, sample = shared.value
        count, radius, cell_of = lists.value
        for b in batches:
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("v"), d)
            seeds, seed_dist = in_sample(ids, x, sample_ids, sample, k)
            limit = seed_dist.max(1) if len(x) else np.zeros(0)
            out: list[tuple] = []
            for lo in range(0, len(x), ROWS):
                far = np.sqrt(np.maximum(distances(x[lo : lo + ROWS], centres), 0))
                near = np.argsort(far, 1, kind="stable")[:, :probes]
                ok = np.take_along_axis(far, near, 1) - radius[near] <= limit[lo : lo + ROWS, None] * (1 + 1e-9) + 1e-6 * np.abs(x).max()
                ok &= count[near] > 0
                for i in range(len(near)):
                    mine = near[i, ok[i]]
                    mine = mine[np.argsort(cell_of[mine], kind="stable")]
                    cells, first = np.unique(cell_of[mine], return_index=True)
                    seen = int(count[mine].sum())
                    out += [(int(c), lo + i, part.astype(np.int32).tobytes(), seen, [], []) for c, part in zip(cells, np.split(mine, first[1:]), strict=True)]
                    some = seeds[lo + i] >= 0
                    out.append((-1, lo + i, b"", seen, seeds[lo + i, some].tolist(), seed_dist[lo + i, some].tolist()))
            cells, at, parts, seen, *seeds = zip(*out, strict=True) if out else ((),) * 6
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "vec_id": pa.array(ids[at]), "v": b.column("v").take(pa.array(at)), "limit": pa.array(limit[at]), "lists": pa.array(parts, pa.binary()), "seen": pa.array(seen, pa.int64()), "seeds": pa.array(seeds[0], pa.list_(pa.int64())), "seed_scores": pa.array(seeds[1], pa.list_(pa.float64()))})

    probing = common.kept(have.where("asks").select("vec_id", "v").mapInArrow(ask, "cell int, vec_id bigint, v binary, limit double, lists binary, seen bigint, seeds array<bigint>, seed_scores array<double>"), "ann-probes")
    seeds = probing.where("cell < 0").select("vec_id", "seen", F.explode(F.arrays_zip("seeds", "seed_scores")).alias("x")).select(F.col("vec_id").alias("query_id"), F.col("x.seeds").alias("vec_id"), F.col("x.seed_scores").alias("score"), F.col("seen").alias("n_scanned"))
    probing = probing.where("cell >= 0").drop("seeds", "seed_scores")
    n_cells = int(cell_of.max()) + 1
    asks = np.zeros(n_cells, np.int64)
    for x in probing.groupBy("cell").count().collect():  # a row for each cell
        asks[x["cell"]] = x["count"]
    # a cell's vectors in chunks, its queries in blocks: each pair of a chunk and a block is one group of bounded size
    chunks, blocks = (F.array(*(F.lit(int(x)) for x in -(-np.maximum(c, 1) // size))) for c, size in ((np.bincount(cell_of, count, n_cells).astype(np.int64), 2 * CHUNK), (asks, QUERIES)))
    sizes_ = spark.range(1).select(F.posexplode(F.arrays_zip(chunks.alias("chunks"), blocks.alias("blocks"))).alias("cell", "x")).select("cell", "x.chunks", "x.blocks")
    cells = spark.range(1).select(F.posexplode(F.array(*(F.lit(int(c)) for c in cell_of))).alias("list", "cell")).join(sizes_, "cell")

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    names = ["cell", "chunk", "block", "vec_id", "v", "list", "limit", "lists", "seen"]
    nothing = {"limit": F.lit(0.0), "lists": F.lit(None).cast("binary"), "seen": F.lit(0).cast("bigint")}
    stored = have.select("vec_id", "v", "list").join(F.broadcast(cells), "list").withColumns(nothing | {"chunk": part("chunks"), "block": every("blocks")}).select(names)
    asked = probing.join(F.broadcast(sizes_), "cell").withColumns({"list": F.lit(-1), "block": part("blocks"), "chunk": every("chunks")}).select(names)

    def both(group: pa.Table) -> pa.Table:
        is_query = group.column("list").to_numpy() < 0
        vectors, asking = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("n_scanned", pa.int64())])
        if not vectors.num_rows or not asking.num_rows:
            return schema.empty_table()
        names, of = np.unique(vectors.column("list").to_numpy(), return_inverse=True)
        probed = np.zeros((asking.num_rows, len(names)), bool)
        for i, x in enumerate(asking.column("lists").to_pylist()):
            probed[i] = np.isin(names, np.frombuffer(x, np.int32))
        query_ids = asking.column("vec_id").to_numpy()
        order = np.argsort(vectors.column("vec_id").to_numpy(), kind="stable")
        ids, x = vectors.column("vec_id").to_numpy()[order], _matrix(vectors.column("v"), d)[order]
        at, near, score = scan(ids, x, of[order], query_ids, _matrix(asking.column("v"), d), asking.column("limit").to_numpy(), probed, shared.value[1], k)
        return pa.table([pa.array(query_ids[at]), pa.array(near), pa.array(score), asking.column("seen").take(pa.array(at)).combine_chunks()], schema=schema)

    found = stored.unionByName(asked).groupBy("cell", "chunk", "block").applyInArrow(both, "query_id bigint, vec_id bigint, score double, n_scanned bigint")
    found = found.unionByName(seeds).repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("n_scanned").alias("n_scanned"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scanned")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
