"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document is the set of its word ``n``-grams (five; a document of fewer words, but not none, is one gram of all). Documents
of one set are one text class, with its least id and its number of ids, and go on as one. ``BANDS`` bands of ``ROWS`` MinHash
values deal the classes to buckets; a pair of similarity 0.8 shares none once in 200,000.

Candidates are what shares a bucket. Their MinHash values (a byte of each) are compared ``STEP`` at a time; a pair is dropped
as soon as the posterior probability (uniform prior) that its similarity reaches the threshold is below ``tolerance``. What
survives only has to hang together at this point, so a bucket's members are searched breadth first: a member that is reached
is compared with those not yet reached, and only the tree's links are written. So texts that share a bucket but no real
likeness fall apart here, and the shuffle grows with members and buckets, not with pairs.

Components of these links hold every pair that survives. In a component, all pairs are taken by blocks of members, dealt so
that each task has about as many; the survivors of the same pruning are verified exactly on the sets. Only sums and one link
to the least partner leave a task for each member, so a large group of near copies isn't written out as pairs. The number of
links is part of the result, so within a group of texts that really are alike the work grows with the square of its different
texts.

Cases: a null, empty or wordless text links to nothing and is a class of its own; exact copies are linked to each other and
to all that their class is linked to; a row that repeats an id and a set counts once; an id with several sets counts once for
each; rows without an id have no class; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .components import SALTS, components

BANDS, ROWS, STEP = 40, 6, 16
HASHES = BANDS * ROWS
#: Members of a bucket that are compared in one task at once; more are dealt to several blocks.
BUCKET = 2048
#: Members and grams of one block of a component, and up to how many members a component is one block.
BLOCK, BLOCK_GRAMS, ONE_BLOCK = 1024, 1_000_000, 400
_RNG = np.random.Generator(np.random.PCG64(5))
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64)


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    data, at = words.utf8(column)
    first, _, h = words.words(data, at)
    of = words.counts(first, at)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        own = h[a:b]
        g = np.sort(words.grams(own, n if b - a >= n else b - a)) if b > a else own
        yield g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of each set; none may be empty."""
    out = np.empty((HASHES, len(sets)), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size < 50_000):
            size += len(sets[hi])
            hi += 1
        flat = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        begin = np.concatenate(([0], np.cumsum([len(s) for s in sets[lo : hi - 1]]))).astype(np.int64) if hi - lo > 1 else np.zeros(1, np.int64)
        scratch = np.empty_like(flat)
        for k in range(HASHES):
            np.bitwise_xor(flat, _XOR[k], out=scratch)
            np.multiply(scratch, _MUL[k], out=scratch)
            out[k, lo:hi] = np.minimum.reduceat(scratch, begin)
        lo = hi
    return np.ascontiguousarray(out.T)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each STEP of values: the fewest matches that a pair may have. With a uniform prior, P(s >= t | m of n match) is
    the probability that of n + 1 draws with chance t at most m succeed."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked(a: list[np.ndarray], sig_a: np.ndarray, b: list[np.ndarray], sig_b: np.ndarray, threshold: float, least: list[int], same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a, the sets of b (after it, if they are the same) whose Jaccard similarity reaches threshold."""
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    grams, inverse = np.unique(np.concatenate(b), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size_b)[:-1]))
    mark = np.zeros(len(grams) + 1, bool)
    for i in range(len(a)):
        j = np.flatnonzero((np.minimum(size_b, size_a[i]) >= threshold * np.maximum(size_b, size_a[i]) - 1e-9) & ((np.arange(len(b)) > i) | (not same)))
        match = np.zeros(len(j), np.int64)
        for k, need in enumerate(least):
            if not len(j):
                break
            match += (sig_b[j, k * STEP : (k + 1) * STEP] == sig_a[i, k * STEP : (k + 1) * STEP]).sum(1)
            stay = match >= need
            j, match = j[stay], match[stay]
        if not len(j):
            continue
        where = np.searchsorted(grams, a[i])
        where[grams[np.minimum(where, len(grams) - 1)] != a[i]] = len(grams)
        mark[where] = True
        mark[-1] = False
        if len(j) * 4 > len(b):
            shared = np.add.reduceat(mark[inverse], begin, dtype=np.int64)[j]
        else:
            shared = np.array([np.count_nonzero(mark[inverse[begin[x] : begin[x] + size_b[x]]]) for x in j])
        mark[where] = False
        found = j[shared / (size_a[i] + size_b[j] - shared) >= threshold]
        if len(found):
            yield i, found


def survive(sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """Which of the pairs (a, b) may reach threshold, by their sizes and MinHash values."""
    live = np.flatnonzero(np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
    match = np.zeros(len(live), np.int64)
    for k, need in enumerate(least):
        if not len(live):
            break
        own = slice(k * STEP, (k + 1) * STEP)
        match += (sig[a[live], own] == sig[b[live], own]).sum(1)
        stay = match >= need
        live, match = live[stay], match[stay]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def trees(sig: np.ndarray, size: np.ndarray, side: np.ndarray | None, threshold: float, least: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Links that hold together what surviving pairs connect, breadth first: (member, members first reached from it).
    side: if there are two blocks, only pairs across them are taken."""
    left = np.arange(len(size))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            v = reached.pop()
            ask = np.ones(len(left), bool) if side is None else side[left] != side[v]
            ask[ask] = survive(sig, size, np.full(int(ask.sum()), v), left[ask], threshold, least)
            if ask.any():
                yield v, left[ask]
                reached += left[ask].tolist()
                left = left[~ask]


def signatures(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, a hash of the text, grams, two halves of a hash of the set, a byte of each MinHash value, hashes of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(gram_sets(batch.column(2), n))
            some = [i for i, s in enumerate(sets) if len(s)]
            bands, bytes_ = np.zeros((len(sets), BANDS), np.int64), [b""] * len(sets)
            if some:
                sig = minhash([sets[i] for i in some])
                for i, x in zip(some, sig.astype(np.uint8), strict=True):
                    bytes_[i] = x.tobytes()
                sig = sig.astype(np.uint64).reshape(len(some), BANDS, ROWS)
                bands[some] = words.mix((sig * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            x = [int(set_hash(s)) if len(s) else 0 for s in sets]
            y = [int(set_hash(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], x, y)), pa.array(bytes_, pa.binary()), flat]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "grams", "x", "y", "sig", "bands"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, t bigint, grams bigint, x bigint, y bigint, sig binary, bands array<bigint>")


def set_hash(s: np.ndarray) -> np.int64:
    return words.mix(s).sum(dtype=np.uint64).astype(np.int64)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """Members with their set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "key", "copies", "n_blocks", "sig"]
        for batch in batches:
            sets = [s.tobytes() for s in gram_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "grams"])

    return rows.select("root", "key", "copies", "n_blocks", "sig", "text").mapInArrow(run, "root bigint, key bigint, copies bigint, n_blocks int, sig binary, grams binary")


def in_blocks(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """Each member of a group once for each pair (i, j) of blocks that has its block. The pairs of a group are dealt to the
    partitions in turn, and sorted so that the members of a pair stand together."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n_blocks")
    turn = F.col("j").cast("bigint") * (F.col("j") + 1) / 2 + F.col("i")
    place = F.pmod(F.pmod(F.xxhash64(group), F.lit(parts)) + turn.cast("bigint"), F.lit(parts)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions(group, "i", "j", "key")


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the first row of each group and the number of rows after the last."""

    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        out = pa.Table.from_batches(parts)
        k = np.stack([out.column(c).to_numpy() for c in names])
        return out, np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [out.num_rows]))

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        begin = 0
        if held and (k[:, 0] == last).all():
            if not len(cut):
                held.append(batch)
                continue
            begin = int(cut[0])
            held.append(batch.slice(0, begin))
        if held:
            yield table(held)
        end = int(cut[-1]) if len(cut) else 0
        if end > begin:
            yield table([batch.slice(begin, end - begin)])
        held, last = [batch.slice(max(begin, end))], k[:, -1]
    if held:
        yield table(held)


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _hanging_together(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """dealt: members of buckets, from in_blocks. Links (a, b) that connect what survives within each pair of blocks."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ("bucket", "i", "j")):
            key, size, block, i, j = (t.column(c).to_numpy() for c in ("key", "grams", "block", "i", "j"))
            sig, n = _bytes(t.column("sig"), HASHES), np.diff(at)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            few = (n <= 8) & (i[at[:-1]] == j[at[:-1]])
            for s in range(2, 9):  # small buckets: all pairs of all buckets of one size at once
                own = at[:-1][few & (n == s)]
                p, q = np.triu_indices(s, 1)
                x, y = (own[:, None] + p).ravel(), (own[:, None] + q).ravel()
                ok = survive(sig, size, x, y, threshold, least)
                a.append(x[ok]), b.append(y[ok])
            for lo, hi in zip(at[:-1][~few].tolist(), at[1:][~few].tolist(), strict=True):
                for v, found in trees(sig[lo:hi], size[lo:hi], block[lo:hi] if i[lo] != j[lo] else None, threshold, least):
                    a.append(np.full(len(found), lo + v)), b.append(lo + found)
            yield pa.RecordBatch.from_arrays([pa.array(key[np.concatenate(a)]), pa.array(key[np.concatenate(b)])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _joined(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """dealt: members of components, from in_blocks. For each linked member of a pair of blocks: linked classes and documents,
    and the least key that it is connected to there."""
    least = least_matches(threshold, tolerance)

    def block(t: pa.Table) -> list[np.ndarray]:
        keys, copies, of, i, j = (t.column(c).to_numpy() for c in ("key", "copies", "block", "i", "j"))
        sets, sig = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()], _bytes(t.column("sig"), HASHES)
        classes, docs, up = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.arange(len(keys))
        a, b = np.flatnonzero(of == i[0]), np.flatnonzero(of == j[0])
        if not len(a) or not len(b):
            return []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for p, found in linked([sets[x] for x in a], sig[a], [sets[x] for x in b], sig[b], threshold, least, i[0] == j[0]):
            x, ys = int(a[p]), b[found]
            classes[x] += len(ys)
            docs[x] += copies[ys].sum()
            classes[ys] += 1
            docs[ys] += copies[x]
            for y in ys.tolist():
                r, s = sorted((top(x), top(y)))  # rows stand in the order of their keys
                up[s] = r
        some = np.flatnonzero(classes)
        return [keys[some], classes[some], docs[some], keys[[top(x) for x in some.tolist()]]] if len(some) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ("root", "i", "j")):
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1 and (found := block(t.slice(lo, hi - lo))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["key", "classes", "docs", "least"])

    return dealt.mapInArrow(run, "key bigint, classes bigint, docs bigint, least bigint")


def entries(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """For each row what join() says, and with it t (xxhash64 of the text) and first: in each group of connected documents,
    one id and text is the first."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = common.kept(signatures(df, doc_id, text, n), "signatures")
    some = own.where((F.col("grams") > 0) & F.col("doc_id").isNotNull())
    # a row for each id of a class, then one for each class; its first id and text stand for it
    held = some.groupBy("x", "y", "doc_id").agg(F.min("t").alias("t"), F.max("grams").alias("grams"))
    classes = held.groupBy("x", "y").agg(F.min("doc_id").alias("id"), F.min_by("t", "doc_id").alias("t"), F.count("*").alias("copies"), F.max("grams").alias("grams"))
    classes = common.kept(classes, "classes")
    marks = some.select("x", "y", F.col("doc_id").alias("id"), "t", "sig", "bands").join(classes, ["x", "y", "id", "t"]).dropDuplicates(["x", "y", "id", "t"])
    marks = common.kept(marks.select(F.col("x").alias("key"), "id", "t", "copies", "grams", "sig", "bands"), "class-marks")

    buckets = marks.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    blocks = F.ceil(F.col("m") / BUCKET).cast("int").alias("n_blocks")
    in_buckets = buckets.join(shared, "bucket").select("bucket", "key", blocks).join(marks.select("key", "grams", "sig"), "key")
    member = components(_hanging_together(in_blocks(in_buckets, "bucket", parts), threshold, tolerance)).withColumnRenamed("id", "key")

    size = member.join(marks.select("key", "grams"), "key").groupBy("root").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    by_size = F.when(F.col("m") > ONE_BLOCK, F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.sqrt("m") / 3))).otherwise(1)
    size = size.select("root", F.greatest(by_size, F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int").alias("n_blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).repartition("root", "salt")  # else a root's salts stay in its task, and all its members meet there if they are broadcast
    known = member.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(size, ["root", "salt"]).drop("salt")
    known = known.join(marks.select("key", "id", "t", "copies", "sig"), "key")
    texts = df.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).join(known, ["id", "t"]).dropDuplicates(["id", "t"])
    found = common.kept(_joined(in_blocks(_sets(texts, n), "root", parts), threshold, tolerance), "joined")

    sums = found.groupBy("key").agg(F.sum("classes").alias("n_class_links"), F.sum("docs").alias("docs"))
    group = components(found.select(F.col("least").alias("a"), F.col("key").alias("b"))).withColumnRenamed("id", "key")
    group = group.join(marks.select("key", "id"), "key")
    tops = group.groupBy("root").agg(F.min(F.struct("id", "key")).alias("top")).select("root", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).repartition("root", "salt")
    group = group.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(tops, ["root", "salt"]).select("key", "top")
    zero = F.lit(0).cast("bigint")
    whole = classes.withColumn("key", F.col("x")).join(sums, "key", "left").join(group, "key", "left").select(
        "x", "y", F.col("id").alias("text_id"), F.col("t").alias("own_t"), F.coalesce("top.id", "id").alias("class_id"), (F.col("top").isNull() | (F.col("top.key") == F.col("key"))).alias("on_top"),
        "copies", F.coalesce("docs", zero).alias("docs"), F.coalesce("n_class_links", zero).alias("n_class_links"),
    )
    first = F.col("on_top") & (F.col("doc_id") == F.col("text_id")) & (F.col("t") == F.col("own_t"))
    keyed = some.select("doc_id", "t", "x", "y").join(whole, ["x", "y"]).select("doc_id", "class_id", "text_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"), "n_class_links", "t", first.alias("first"))
    same = F.col("doc_id")
    alone = own.where((F.col("grams") == 0) | F.col("doc_id").isNull()).select("doc_id", same.alias("class_id"), same.alias("text_id"), zero.alias("n_links"), zero.alias("n_class_links"), "t", F.lit(True).alias("first"))
    return keyed.unionByName(alone)


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """For each row: doc_id, class_id (the least id that it is connected to), text_id (the least id of its set), n_links (other
    documents of similarity threshold or more) and n_class_links (other sets of that similarity)."""
    return entries(df, doc_id, text, n, threshold, tolerance).drop("t", "first")


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))


#: All pairs that share a gram, and all that links reach: for small tables.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS h FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, a.h AS hx, b.h AS hy FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c / (a.n + b.n - c) >= 0.8),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT hy) FILTER (hx <> hy) AS n_class_links FROM l GROUP BY 1)
SELECT doc_id, class_id, coalesce(min(doc_id) OVER (PARTITION BY coalesce(h, CAST(doc_id AS VARCHAR))), doc_id) AS text_id, coalesce(n_links, 0) AS n_links, coalesce(n_class_links, 0) AS n_class_links
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
