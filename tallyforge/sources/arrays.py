"""Arrays of numbers by ranges of rows: .npy files read by many tasks each, and arrays of slots that are filled bit by bit.

``read_ranges`` plans byte ranges from the headers of .npy files; a task seeks to its range and reads no more. ``write_slots`` keeps
an array of n rows as shards of a fixed number of rows, each a .npy file; a row's number says in which shard and at which byte it
lies. Slots that nobody has filled are NaN. A write touches only shards that it has rows for: their tasks write new files beside
the old ones, and only when all tasks are done do these take the old ones' names, so that readers see no half-filled shard and a
write that fails leaves all as it was. A small file beside the shards (written last, likewise) tells shape, shards, empty slots
and hashes; ``damaged_slots`` finds shards that don't fit it, as after a driver lost between two of these renames.

Paths are what pyarrow can open from every machine (shared folders, hdfs, s3, gs); ``readers.npy_rows`` reads whole files by Spark's
own reader instead.

Cases: arrays of any number of dimensions have rows along the first, flattened. Files in Fortran order, of Python objects or cut off
are errors. A file without rows gives none. A row number out of range, a row of another width or a slot given twice in one write is
an error, and nothing is written. A null value or a null number in it fills nothing: it is NaN, as pending.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, place bigint, v array<double>"
_ABOUT = "_slots.json"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """Where the rows of a .npy file begin, how many there are and of what."""

    offset: int
    rows: int
    width: int
    dtype: str


def header(store: fs.FileSystem, path: str) -> Header:
    with store.open_input_file(path) as f:
        start = io.BytesIO(f.read(1 << 16))
        size = f.size()
    version = np.lib.format.read_magic(start)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    rows, width = (shape[0], int(np.prod(shape[1:], dtype=np.int64))) if shape else (1, 1)
    if dtype.hasobject or dtype.names or (fortran and len(shape) > 1):
        raise ValueError(f"{path}: rows of {dtype} in {'Fortran' if fortran else 'C'} order can't be read by ranges")
    found = Header(start.tell(), rows, width, dtype.str)
    if size < found.offset + rows * width * dtype.itemsize:
        raise ValueError(f"{path} is cut off: {size} bytes")
    return found


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int
    head: Header


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytes", 64 << 20))

    def partitions(self) -> Sequence[Range]:
        store, path = _at(self.path)
        info = store.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.path.endswith(".npy"))
        out = []
        for file in files:
            head = header(store, file)
            step = max(1, self.bytes // max(1, head.width * np.dtype(head.dtype).itemsize))
            out += [Range(file, i, min(step, head.rows - i), head) for i in range(0, head.rows, step)]
        return out or [Range(path, 0, 0, Header(0, 0, 0, "<f8"))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = _at(self.path)
        head, dtype = partition.head, np.dtype(partition.head.dtype)
        stride, step = head.width * dtype.itemsize, max(1, (4 << 20) // max(1, head.width * 8))
        with store.open_input_file(partition.path) as f:
            f.seek(head.offset + partition.first * stride)
            for i in range(partition.first, partition.first + partition.rows, step):
                n = min(step, partition.first + partition.rows - i)
                x = np.frombuffer(f.read(n * stride), dtype).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * head.width, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array(np.arange(i, i + n)), lists], names=["path", "place", "v"])


class NpyRanges(DataSource):
    """Rows of the .npy file at path, or of all in that folder; option bytes: how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


@dataclass
class _Written(WriterCommitMessage):
    shards: list[tuple[int, str, int, str]]  # number, path of the new file, empty slots, hash


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    """A file that appears at once."""
    new = f"{path}.{uuid.uuid4().hex}.new"
    with store.open_output_stream(new) as f:
        f.write(content)
    store.move(new, path)


def _shard(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.rows, self.width, self.stride, self.dtype = options["path"], int(options["rows"]), int(options["width"]), int(options["stride"]), options["dtype"]

    def _name(self, shard: int) -> str:
        return f"{_at(self.path)[1].rstrip('/')}/slots-{shard:08d}.npy"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Rows come in the order of their numbers, so one shard is open at a time."""
        store, _ = _at(self.path)
        done: list[tuple[int, str, int, str]] = []
        now, x, seen = -1, np.zeros(0), np.zeros(0, bool)

        def close() -> None:
            if now >= 0:
                content = _shard(x)
                new = f"{self._name(now)}.{uuid.uuid4().hex}.new"
                with store.open_output_stream(new) as f:
                    f.write(content)
                done.append((now, new, int(np.isnan(x.reshape(len(x), -1)).any(1).sum()), hashlib.sha256(content).hexdigest()))

        for b in iterator:
            if not b.num_rows:
                continue
            at = b.column("place").to_numpy()
            values = b.column("v")
            lengths = np.asarray(values.value_lengths().fill_null(self.width))
            if at.min() < 0 or at.max() >= self.rows or (lengths != self.width).any():
                raise ValueError(f"places {at.min()} to {at.max()} of {self.rows}, widths {lengths.min()} to {lengths.max()} of {self.width}")
            v = np.full((len(at), self.width), np.nan)
            there = np.asarray(values.is_valid())
            v[there] = values.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, self.width)
            shards = at // self.stride
            for s in np.unique(shards):
                if s != now:
                    close()
                    now, n = int(s), min(self.stride, self.rows - int(s) * self.stride)
                    if store.get_file_info(self._name(now)).is_file:
                        with store.open_input_file(self._name(now)) as f:
                            x = np.load(io.BytesIO(f.read()), allow_pickle=False).reshape(n, self.width).copy()
                    else:
                        x = np.full((n, self.width), np.nan, self.dtype)
                    seen = np.zeros(n, bool)
                own = at[shards == s] - now * self.stride
                if seen[own].any() or len(np.unique(own)) < len(own):
                    raise ValueError(f"a slot of shard {now} is given twice")
                seen[own] = True
                x[own] = v[shards == s]
        close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = _at(self.path)
        about = about_slots(self.path) or {"rows": self.rows, "width": self.width, "stride": self.stride, "dtype": self.dtype, "shards": {}}
        for number, new, empty, digest in sorted(x for m in messages if m for x in m.shards):
            store.move(new, self._name(number))
            about["shards"][str(number)] = {"empty": empty, "sha256": digest}
        _put(store, f"{path.rstrip('/')}/{_ABOUT}", json.dumps(about, sort_keys=True).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = _at(self.path)
        for x in store.get_file_info(fs.FileSelector(path)):  # no writer but this one works here
            if x.path.endswith(".new"):
                store.delete_file(x.path)


class Slots(DataSource):
    """The writer behind ``write_slots``."""

    @classmethod
    def name(cls) -> str:
        return "npy_slots"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_ranges(spark: SparkSession, path: str, bytes_: int = 64 << 20) -> DataFrame:
    """file, place in it and numbers of each row; tasks of about so many bytes."""
    spark.dataSource.register(NpyRanges)
    return spark.read.format("npy_ranges").option("path", path).option("bytes", str(bytes_)).load()


def about_slots(path: str) -> dict | None:
    store, at = _at(path)
    if not store.get_file_info(f"{at.rstrip('/')}/{_ABOUT}").is_file:
        return None
    with store.open_input_file(f"{at.rstrip('/')}/{_ABOUT}") as f:
        return json.loads(f.read())


def write_slots(df: DataFrame, path: str, rows: int, width: int = 1, stride: int | None = None, dtype: str = "<f4") -> None:
    """df: place (from 0, below rows) and v (width numbers). Fills these slots of the array at path, which is begun if it isn't there; its
    shape, stride and type must be the same each time. stride: rows of a shard (64 MB if not said)."""
    spark, asked = df.sparkSession, stride
    stride = asked or max(1, (64 << 20) // (width * np.dtype(dtype).itemsize))
    store, at = _at(path)
    if there := about_slots(path):
        stride = asked or there["stride"]
        if (there["rows"], there["width"], there["stride"], there["dtype"]) != (rows, width, stride, dtype):
            raise ValueError(f"{path} holds {there['rows']} rows of {there['width']} {there['dtype']} in shards of {there['stride']}")
    store.create_dir(at, recursive=True)
    spark.dataSource.register(Slots)
    shard = F.floor(F.col("place") / stride)
    ordered = df.select(F.col("place").cast("bigint").alias("place"), F.col("v").cast("array<double>").alias("v")).withColumn("shard", shard)
    ordered = ordered.repartition("shard").sortWithinPartitions("place").select("place", "v")
    w = ordered.write.format("npy_slots").mode("append").option("path", path)
    for k, x in (("rows", rows), ("width", width), ("stride", stride), ("dtype", dtype)):
        w = w.option(k, str(x))
    w.save()


def read_slots(spark: SparkSession, path: str, bytes_: int = 64 << 20) -> DataFrame:
    """place and v of every row that a shard has; shards that nobody has written have none yet."""
    about = about_slots(path)
    if about is None:
        raise FileNotFoundError(path)
    number = F.regexp_extract("path", r"slots-(\d+)\.npy$", 1).cast("bigint")
    return read_ranges(spark, path, bytes_).select((number * about["stride"] + F.col("place")).alias("place"), "v")


def pending_slots(spark: SparkSession, path: str) -> DataFrame:
    """place of every slot that is still empty: of shards that have such slots, and of those that aren't there at all."""
    about = about_slots(path)
    if about is None:
        raise FileNotFoundError(path)
    n = -(-about["rows"] // about["stride"])
    missing = spark.range(n).where(~F.col("id").isin([int(k) for k in about["shards"]]) if about["shards"] else F.lit(True))
    size = F.least(F.lit(about["stride"]), F.lit(about["rows"]) - F.col("id") * about["stride"])
    never = missing.select(F.explode(F.sequence(F.col("id") * about["stride"], F.col("id") * about["stride"] + size - 1)).alias("place"))
    if not any(x["empty"] for x in about["shards"].values()):
        return never
    some = read_slots(spark, path).where(F.exists("v", F.isnan)).select("place")
    return some.unionByName(never)


def damaged_slots(path: str) -> list[int]:
    """Shards whose file is gone or isn't the one that was written."""
    store, at = _at(path)
    about, bad = about_slots(path) or {"shards": {}}, []
    for k, x in about["shards"].items():
        name = f"{at.rstrip('/')}/slots-{int(k):08d}.npy"
        if not store.get_file_info(name).is_file:
            bad.append(int(k))
            continue
        digest = hashlib.sha256()
        with store.open_input_file(name) as f:
            while part := f.read(1 << 24):
                digest.update(part)
        if digest.hexdigest() != x["sha256"]:
            bad.append(int(k))
    return sorted(bad)
