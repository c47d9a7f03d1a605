"""Sums of arrays over the partitions of a table, in parallel and in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that one task, or the driver, adds up.
FAN = 32


def _array(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def partition_sum(df: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], size: int, parts: int | None = None) -> np.ndarray:
    """The sum over all batches of df of step(batch), an array of size numbers.

    Every partition adds up its own batches, all at the same time; their arrays
    are added in groups of FAN in the order of the partitions until about FAN
    are left for the driver. parts: the number of partitions, if known; else two
    rounds of groups are made. An empty table gives zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += step(batch)
        yield _array(TaskContext.get().partitionId(), total)

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("sums").to_pylist(), strict=True))
        total = np.zeros(size)
        for _, sums in rows:
            total += np.frombuffer(sums)
        return pa.Table.from_batches([_array(rows[0][0] // FAN, total)])

    found = df.mapInArrow(run, "part long, sums binary")
    left = FAN + 1 if parts is None else parts
    while left > FAN:
        found = found.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(add, "part long, sums binary")
        left = -(-left // FAN)
    total = np.zeros(size)
    for _, sums in sorted((r["part"], bytes(r["sums"])) for r in found.collect()):
        total += np.frombuffer(sums)
    return total
