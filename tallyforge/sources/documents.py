"""The elements of large JSON arrays, by many tasks.

A JSON document has no line ends that one could rely on, but Spark's text reader splits a file at any byte. Here it ends its lines at
closing braces, so a task gets its byte range as strings that end at one. What a range means depends on what stands before it:
whether it begins within a string, and how deep. So there are two passes. The first gives, for each range, whether its quotes turn
that around and how far it goes up or down, for either beginning; a running sum over ranges (one row for each) then tells where each
begins. The second cuts out the elements; of those that go over the end of a range the pieces, a few for each range, are put together
by their order.

Cases: elements are objects and arrays inside the outermost array; plain values there aren't records and are left out. A file that is
one object, not an array, gives that object. An empty file or array gives nothing. Braces, brackets and escaped quotes in strings are
text. A file that ends within an element or a string is an error. Text between two closing braces, however long, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OPEN, _CLOSE = (np.zeros(256, np.int8) for _ in range(2))
_OPEN[[ord("{"), ord("[")]] = 1
_CLOSE[[ord("}"), ord("]")]] = 1


def _inside(data: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """Whether each byte stands within a string (an opening quote not, a closing one yes), and whether the end does."""
    if not len(data):
        return np.zeros(0, bool), start
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 0x5C, at, -1))  # the last byte that isn't a backslash
    quote = data == 0x22
    before = np.concatenate(([-1], plain[:-1]))
    quote &= (at - 1 - before) % 2 == 0  # an even number of backslashes before it
    turned = np.cumsum(quote)
    return (turned - quote + start) % 2 == 1, bool((turned[-1] + start) % 2)


def _steps(data: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """+1 for each bracket that opens, -1 for each that closes, outside of strings."""
    inside, end = _inside(data, start)
    return np.where(inside, 0, _OPEN[data] - _CLOSE[data]), end


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """File, beginning and bytes of each range that a batch has rows of, about a million bytes at a time; the braces that the reader
    took away are there again."""
    path, start = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
    of, value = path.indices.to_numpy(), batch.column("value").cast(pa.large_binary())
    upto = np.cumsum(pc.binary_length(value).to_numpy().astype(np.int64) + 1) >> 20
    cut = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (upto[1:] != upto[:-1]), [True])))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield path[int(a)].as_py(), int(start[a]), np.frombuffer(b"}".join(value.slice(a, b - a).to_pylist()) + b"}", np.uint8)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = {"path": "file_path", "start": "file_block_start", "size": "file_size"}
    return spark.read.option("lineSep", "}").text(path).select("value", *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()])


def _beginnings(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each range whether it begins within a string, its depth, and the depth of its file's elements: one row for each range comes
    to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size = dict(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True))
            for path, start, data in _ranges(batch):
                # the strings are turned, depth if it begins outside of one, if inside; bytes; the file's size; the first that isn't blank
                own = found.setdefault((path, start), [False, 0, 0, 0, size[path], 0])
                (outside, end), (inside, _) = (_steps(data, own[0] != first) for first in (False, True))
                own[:4] = end, own[1] + int(outside.sum()), own[2] + int(inside.sum()), own[3] + len(data)
                own[5] = own[5] or next((x for x in data[:4096].tolist() if x not in b" \t\r\n\xef\xbb\xbf"), 0)
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("turned", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("first", pa.int32())])
    ranges = sorted(lines.mapInArrow(run, "path string, start bigint, turned boolean, outside bigint, inside bigint, bytes bigint, size bigint, first int").collect())
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    for path, own in groupby(ranges, key=lambda r: r.path):
        text, depth, read, level = False, 0, 0, None
        for r in own:
            level = level or {ord("["): 2, ord("{"): 1}.get(r.first)
            out[path, r.start] = text, depth, level or 2
            text, depth, read = text != r.turned, depth + (r.inside if text else r.outside), read + r.bytes
        ends = read == r.size  # else the last brace isn't in the file
        if text or depth != (0 if ends else -1):
            raise ValueError(f"{path} ends within an element or isn't JSON")
    return out


def elements(spark: SparkSession, path: str) -> DataFrame:
    """path and value (JSON text) of every element."""
    lines = _lines(spark, path)
    shared = spark.sparkContext.broadcast(_beginnings(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, rows = shared.value, []
        at, text, depth, level = None, False, 0, 2
        held: list[bytes] = []  # of an element that is open
        here = False  # whether it began in this range
        for batch in batches:
            for file, start, data in _ranges(batch) if batch.num_rows else ():
                if at != (file, start):
                    if held:
                        rows.append((*at, 2 if here else 1, b"".join(held)))
                    at, held, here = (file, start), [], False
                    text, depth, level = begin[at]
                steps, end = _steps(data, text)
                after = depth + np.cumsum(steps)
                opens, closes = np.flatnonzero((steps > 0) & (after == level)), np.flatnonzero((steps < 0) & (after == level - 1))
                if (held or depth >= level) and not len(closes):
                    held.append(data.tobytes())
                elif held or depth >= level:
                    rows.append((*at, 3 if here else 0, b"".join(held) + data[: int(closes[0]) + 1].tobytes()))
                    held, here, closes = [], False, closes[1:]
                rows += [(*at, 3, data[a : b + 1].tobytes()) for a, b in zip(opens, closes, strict=False)]
                if len(opens) > len(closes):
                    held, here = [data[int(opens[-1]) :].tobytes()], True
                text, depth = end, int(after[-1])
                if sum(len(r[3]) for r in rows) > 4 << 20:
                    yield _rows(rows)
                    rows = []
        if held:
            rows.append((*at, 2 if here else 1, b"".join(held)))
        yield _rows(rows)

    # kinds: 0 the end of an element, 1 its middle, 2 its beginning, 3 a whole one
    found = lines.drop("size").mapInArrow(run, "path string, start bigint, kind int, value string")
    pieces = found.where("kind < 3").withColumn("n", F.sum((F.col("kind") == 2).cast("int")).over(Window.partitionBy("path").orderBy("start", "kind")))
    joined = pieces.groupBy("path", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))), lambda p: p["value"]), "").alias("value"))
    return found.where("kind = 3").select("path", "value").unionByName(joined.select("path", "value"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    path, start, kind, value = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array([v.decode() for v in value], pa.string())], names=["path", "start", "kind", "value"])
