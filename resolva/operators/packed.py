"""Encoded rows as packed numpy blocks, for fits that read them many times.

An iterative fit makes one small pass over its rows per step, hundreds of them.
The rows are packed once into a few numpy arrays per partition and kept as an
RDD, spilled to disk where memory is short; a step is then one job of numpy
sums per partition and a tree reduction, without a query to plan. The driver
only sees one sum. Rows are dealt evenly before they are packed: a step lasts as
long as its largest partition, and each partition costs a task per step,
however the rows' files or shuffles were cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET

#: Partial sums of up to this many partitions go to the driver directly.
DIRECT = 64
#: Rows of a partition: few rows are not worth a task, and many are cut to fit a task's memory.
LEAST_ROWS, MOST_ROWS = 8_192, 65_536


def n_partitions(n: int, slots: int) -> int:
    """Even partitions of n rows: one per LEAST_ROWS up to one per slot, beyond
    that whole rounds of the slots with at most MOST_ROWS a partition."""
    slots = max(1, slots)
    return max(1, min(slots, -(-n // LEAST_ROWS)), slots * -(-n // (slots * MOST_ROWS)) if n > slots * MOST_ROWS else 1)


def cells_of(cells: pa.Array) -> np.ndarray:
    """The rows' column numbers as a matrix; every row has one per feature."""
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)


class Block:
    """Rows of one batch: hashed keys, targets, column numbers and margins."""
    __slots__ = ("key", "y", "cells", "margin")

    def __init__(self, key: np.ndarray, y: np.ndarray, cells: np.ndarray, margin: np.ndarray):
        self.key, self.y, self.cells, self.margin = key, y, cells, margin


def packed(rows: DataFrame, key: str = "case_id") -> RDD:
    """Blocks of encoded rows (key, target, cells) in even partitions, persisted."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                cells = cells_of(batch.column(2)).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(y)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys.astype("<i8"), y.astype("<f8"), cells))],
                    names=["n", "key", "y", "cells"])

    def unpack(r) -> Block:
        return Block(np.frombuffer(r["key"], "<i8"), np.frombuffer(r["y"], "<f8"),
                     np.frombuffer(r["cells"], "<i4").reshape(r["n"], -1), np.zeros(r["n"]))

    kept = rows.select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(TARGET).cast("double").alias("y"), "cells")
    kept = kept.repartition(n_partitions(kept.count(), rows.sparkSession.sparkContext.defaultParallelism))
    return kept.mapInArrow(pack, "n long, key binary, y binary, cells binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def summed(blocks: RDD, size: int, add: Callable[[Block, np.ndarray], None], kind: str = "f8") -> np.ndarray:
    """The sum over all blocks of what `add` adds to a vector of `size` numbers."""
    def partial(found: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros(size, kind)
        for block in found:
            add(block, total)
        yield total

    parts = blocks.mapPartitions(partial)
    if blocks.getNumPartitions() <= DIRECT:
        return sum(parts.collect(), np.zeros(size, kind))
    return parts.treeReduce(np.add, depth=2)
