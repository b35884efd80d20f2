"""Sums of long vectors over tasks, and samples by hash, without a group or a driver that holds all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Numbers of a vector that go together.
BLOCK = 8192


def vector_sum(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of what part gives for each task's rows, a vector of that size. Blocks of it are shuffled by number, and each is added up
    in the order of the tasks: the driver gets one vector, however many tasks there are, and reruns give the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = part(batches)
        at = range(0, len(flat), BLOCK)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"block": pa.array([x // BLOCK for x in at], pa.int32()), "task": pa.array([task] * len(at), pa.int32()), "x": pa.array([flat[x : x + BLOCK] for x in at], pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("x"), strict=True):
                own = x.values.to_numpy()
                sums[block] = sums[block] + own if block in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "x": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "block int, task int, x array<double>")
    got = parts.repartition("block").sortWithinPartitions("block", "task").mapInArrow(add, "block int, x array<double>").collect()  # one vector
    return np.concatenate([np.array(r.x) for r in sorted(got, key=lambda r: r.block)]) if got else np.zeros(size)
