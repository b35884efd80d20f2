"""Training-order materialisation: fixed-stride binary shards in the order of a keyed permutation.

Every document's ids (with the end id) are cut into sequences of ``size`` tokens. A document of n bytes has at most
ceil((n + 1) / size) of them, since a token has a byte or more; so many numbers are set aside for it, M for all documents. P is a
keyed Feistel network over the next even power of two, walked along its cycles until it lands below M. Sequence number i comes
at P(i); unused numbers are skipped, so a sequence's slot is how many sequences come before it. Ranges of ``width`` values of P
are the partitions; each writes one shard file of records of equal length by Spark's own committer, in order:

    P(i), document id, start in the document (int64 each), tokens, CRC-32 (uint32 each), ids (little endian, zero padded), \\n

A manifest beside the shards (_manifest.json, written last) holds the stride, the number of slots, the key and each shard's
first slot, and slot s stands (s - first) strides into its shard: a reader of any process resumes anywhere by one seek.
``read_shards`` reads from any slot to any other, and opens only the shards between. ``width`` grows with M, so that there are about
16,384 shards, as long as a shard stays below ``MOST`` bytes: a shard is one row where Spark reads it.

Texts are tokenized once. Before that, bytes are summed by partition (a number for each partition goes to the driver); the
pass that writes fails if it meets other sums. An input that isn't a plain scan is first written to the shared folder, so that
its partitions stay what they were. Ids are compressed while they are shuffled.

Cases: a null or empty text is one sequence of the end id; a null document id is written as 0 with the top bit of the record's
number of tokens set, and read as null;
repeated rows are sequences of their own; an empty table writes no shard.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import vocabulary
from .tokens import encoder
from .words import utf8

#: Set in n_tokens if the document has no id.
NO_ID = 1 << 31
MANIFEST = "_manifest.json"
#: Bytes of a shard, at most.
MOST = 256 << 20
HEAD = np.dtype([("order", "<i8"), ("doc_id", "<i8"), ("start", "<i8"), ("n_tokens", "<u4"), ("ids_crc32", "<u4")])


def feistel(i: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1 that key picks."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, live = i.astype(np.uint64), np.arange(len(i))
    keys = np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, rounds, dtype=np.uint64)
    while len(live):
        x = out[live]
        left, right = x >> shift, x & low
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(33)) & low)
        out[live] = (left << shift) | right
        live = live[out[live] >= n]
    return out.astype(np.int64)


def bound(n_bytes: np.ndarray, size: int) -> np.ndarray:
    return -(-(n_bytes + 1) // size)


def write_shards(df: DataFrame, out: str, path: str, size: int = 512, end: int = 2, key: int = 20240229, width: int | None = None, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Writes the shards and their manifest to out; returns the manifest."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if df._jdf.queryExecution().sparkPlan().collectLeaves().size() != 1 or "FileScan" not in (plan := df._jdf.queryExecution().executedPlan().toString()) or "Exchange" in plan:
        rows = common.kept(rows, "training-order-input")
    sums = rows.select(F.spark_partition_id().alias("part"), F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / size).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    per = {x.part: x.n for x in sums.collect()}
    begin = np.concatenate(([0], np.cumsum([per.get(k, 0) for k in range(max(per, default=-1) + 1)]))).astype(np.int64).tolist()
    m = begin[-1]
    kind = "<u2" if encoder(path).exact.get_vocab_size() <= 1 << 16 else "<u4"
    payload = size * np.dtype(kind).itemsize
    stride = HEAD.itemsize + payload + 1
    width = width or min(max(1, MOST // stride), max(1 << 16, -(-m // (1 << 14))))
    how = {"size": size, "stride": stride, "kind": kind, "end": end, "key": key, "numbers": m, "width": width, "shards": [], "first": [], "n": 0}
    if not m:
        write_text(spark, f"{out}/{MANIFEST}", json.dumps(how))
        return how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        at, stop = (begin[k] if k < len(begin) else m for k in (part, part + 1))  # splits without rows have no sums
        press = zstandard.ZstdCompressor(level=1, write_checksum=False, write_dict_id=False)
        for batch in batches:
            head, body = [], []
            _, byte_at = utf8(batch.column(1))
            number = at + np.concatenate(([0], np.cumsum(bound(np.diff(byte_at), size))))
            for doc, t, first in zip(batch.column(0).to_pylist(), batch.column(1), number.tolist(), strict=False):
                ids = enc.array(t.as_py() or "", end)
                for k, a in enumerate(range(0, len(ids), size)):
                    piece = ids[a : a + size]
                    head.append((first + k, doc or 0, a, len(piece) | (NO_ID if doc is None else 0), zlib.crc32(piece.astype("<u4").tobytes())))
                    body.append(press.compress(piece.astype(kind).tobytes()))
            at = int(number[-1])
            heads = np.array(head, HEAD)
            heads["order"] = feistel(heads["order"], m, key)
            raw = heads.tobytes()
            yield pa.RecordBatch.from_pydict({"order": pa.array(heads["order"].copy()), "record": pa.array([raw[i * HEAD.itemsize : (i + 1) * HEAD.itemsize] + b for i, b in enumerate(body)], pa.binary())})
        if at != stop:
            raise RuntimeError(f"partition {part} ends at number {at}, not at {stop} as when bytes were summed")

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            full = [r[: HEAD.itemsize] + press.decompress(r[HEAD.itemsize :]).ljust(payload, b"\0") for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"record": pa.array(full, pa.binary())})

    numbered = rows.mapInArrow(run, "order bigint, record binary")
    dealt = numbered.repartitionById(-(-m // width), F.floor(F.col("order") / width).cast("int")).sortWithinPartitions("order")
    # the text writer writes a record's bytes as they are and a line feed after each
    dealt.mapInArrow(padded, "record binary").select(F.col("record").cast("string").alias("value")).write.text(out)
    files = spark.read.format("binaryFile").load(f"{out}/part-*").select("path", "length").collect()  # a row for each shard
    for number, length in sorted((shard_of(x.path), x.length) for x in files):
        if length % how["stride"]:
            raise RuntimeError(f"shard {number} has {length} bytes, which isn't a multiple of {how['stride']}")
        how["shards"].append(number)
        how["first"].append(how["n"])
        how["n"] += length // how["stride"]
    write_text(spark, f"{out}/{MANIFEST}", json.dumps(how))
    return how


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _open(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def manifest(spark: SparkSession, out: str) -> dict:
    """What write_shards() left in out."""
    at, fs = _open(spark, f"{out}/{MANIFEST}")
    stream = fs.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def shard_of(path: str) -> int:
    return int(re.search(r"part-(\d+)[^/]*$", path)[1])


def read_shards(spark: SparkSession, out: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """slot, shard (in order), offset (bytes in it), doc_id, start, n_tokens, ids_crc32 and ids of every record from slot begin to before
    slot end (all, if not said), read from the files by their manifest. Shards that have no such slot aren't opened."""
    how = manifest(spark, out)
    stride, kind = how["stride"], how["kind"]
    begin, end = max(begin, 0), how["n"] if end is None else min(end, how["n"])
    schema = "slot bigint, shard int, offset bigint, doc_id bigint, start bigint, n_tokens int, ids_crc32 bigint, ids array<int>"
    if begin >= end:
        return spark.createDataFrame([], schema)
    common.ship(spark)
    stops = [*how["first"][1:], how["n"]]
    wanted = {n for n, a, b in zip(how["shards"], how["first"], stops, strict=True) if a < end and b > begin}
    at, fs = _open(spark, out)
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    files = spark.read.format("binaryFile").load([f"{out}/{x}" for x in names if x.startswith("part-") and shard_of(x) in wanted])
    known = spark.sparkContext.broadcast({n: (i, f) for i, (n, f) in enumerate(zip(how["shards"], how["first"], strict=True))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.dtype([("head", HEAD), ("ids", kind, (how["size"],)), ("end", "S1")])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, first = known.value[shard_of(path)]
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % stride:
                    raise ValueError(f"a shard has {len(raw)} bytes, which isn't a multiple of {stride}")
                found = raw.view(whole)
                last = min(len(found), end - first)
                for lo in range(max(0, begin - first), last, 1024):
                    part = found[lo : min(lo + 1024, last)]
                    h, n, place = part["head"], (part["head"]["n_tokens"] & ~np.uint32(NO_ID)).astype(np.int64), np.arange(lo, lo + len(part))
                    doc = h["doc_id"].copy()
                    flat = part["ids"][np.arange(part["ids"].shape[1]) < n[:, None]].astype(np.int32)
                    yield pa.RecordBatch.from_pydict({
                        "slot": pa.array(first + place), "shard": pa.array(np.full(len(part), shard, np.int32)), "offset": pa.array(place * stride), "doc_id": pa.array(doc, mask=h["n_tokens"] >= NO_ID), "start": pa.array(h["start"].copy()),
                        "n_tokens": pa.array(n.astype(np.int32)), "ids_crc32": pa.array(h["ids_crc32"].astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat)),
                    })

    return files.select("path", "content").mapInArrow(run, schema)


def op7_training_order(spark, sf_dir: str) -> DataFrame:
    """The shards' records as read back from the files."""
    out = common.scratch(spark, "shards")
    write_shards(common.read(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"))
    return read_shards(spark, out).drop("ids")
