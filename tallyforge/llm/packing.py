"""Best-fit packing by sum of squares.

Whole documents are tokenized, and those longer than a sequence are cut into full pieces after a first, shorter one. A full
piece is a sequence of its own, numbered where it is cut, and isn't shuffled. A shorter one goes into the open sequence where
the sum over all residual gaps g of (open sequences with gap g)^2 becomes smallest; ties go to the smallest gap. A new sequence
is opened only if no open one has room: weighed by the sum alone, a new one wins too often, and one in a hundred more are made.
Pieces are placed from the longest to the shortest.

Pieces are packed in groups of about ``group`` short pieces, dealt by a hash of their place in the table of pieces, so no task
gathers more than a bounded number, whatever ids repeat; each group leaves a few sequences open, which is why groups are large.
Texts don't move: only lengths and checksums are shuffled. Cases: a null or empty text is one piece of the end id; repeated
rows are packed one by one; the order in a group is by length, checksum and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: all full but the first."""
    pieces = max(1, -(-n // size))
    first = n - size * (pieces - 1)
    return [(0, first)] + [(first + size * i, size) for i in range(pieces - 1)]


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, in the given order, and the number of sequences."""
    open_count = np.zeros(size + 1, np.int64)  # by gap
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    of, at, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum if gap g becomes g - s; none is open with the gap of a whole sequence, which stands for a new one
        change = 1 - 2 * open_count[s:]
        change[1:] += 2 * open_count[1 : size - s + 1] + 1
        change[open_count[s:] == 0] = np.iinfo(np.int64).max - 1
        change[-1] = np.iinfo(np.int64).max - 2
        g = s + int(change.argmin())
        if g == size:
            which, n = n, n + 1
        else:
            which = stacks[g].pop()
            open_count[g] -= 1
        of[i], at[i] = which, size - g
        if g > s:
            stacks[g - s].append(which)
            open_count[g - s] += 1
    return of, at, n


def pieces(df: DataFrame, path: str, size: int, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    common.ship(df.sparkSession)
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.array(t.as_py() or "", end)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                out += [(key, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cuts(len(ids), size))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(df: DataFrame, path: str, size: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text", group: int = 60_000) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    found = common.kept(pieces(df, path, size, end, doc_id, text).withColumn("place", F.monotonically_increasing_id()), "pieces")
    full = found.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("place"), "offset": F.lit(0).cast("bigint")}).drop("place")
    short = found.where(F.col("length") < size)
    groups = max(1, -(-short.count() // group))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, [("length", "descending"), ("ids_crc32", "ascending"), ("place", "ascending")]))
        of, at, _ = place(rows.column("length").to_numpy(), size)
        number = rows.column("pack").to_numpy() * (1 << 40) + of
        return rows.drop_columns(["pack", "place"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(at))

    kind = df.schema[doc_id].dataType.simpleString()
    dealt = short.withColumn("pack", F.pmod(F.xxhash64("place"), F.lit(groups)))
    filled = dealt.groupBy("pack").applyInArrow(fill, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return filled.unionByName(full)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
