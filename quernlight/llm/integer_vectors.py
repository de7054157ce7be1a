"""Whole-number vectors: what the clustering and the code compression share.

Components become floor(scale * x). All later arithmetic is in whole numbers, so
sums over partitions are the same in any order and on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Largest component in size: squared distances of vectors up to this size fit in 64 bits.
LARGEST = 1 << 26


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have `dim` whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def whole_numbers(df: DataFrame, vector_col: str, scale: int, beside: list[str], dim: int | None = None) -> DataFrame:
    """`beside` and q (array of int) of the rows whose vector is neither null nor holds null
    or non-finite components (and has `dim` of them, if given). A component beyond
    LARGEST / scale raises an error: its distances don't fit in 64 bits."""
    vectors = df.select(*beside, F.col(vector_col).cast("array<double>").alias("q"))
    fields = T.StructType([vectors.schema[c] for c in beside] + [T.StructField("q", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            length = np.asarray(lists.value_lengths().fill_null(-1))
            values = lists.flatten().to_numpy(zero_copy_only=False)  # null lists have no values, null components are NaN
            ends = np.cumsum(np.maximum(length, 0))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (length >= 0) & (bad[ends] == bad[ends - np.maximum(length, 0)])
            if dim is not None:
                good &= length == dim
            scaled = np.floor(values[np.repeat(good, np.maximum(length, 0))] * scale)
            if len(scaled) and np.abs(scaled).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST} / {scale}: its distances don't fit in 64 bits")
            offsets = np.concatenate([[0], np.cumsum(length[good])]).astype(np.int32)
            kept = batch.filter(pa.array(good))
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], whole], schema=arrow)

    return vectors.mapInArrow(run, fields)


class Sums:
    """Exact sums of vectors by group."""

    def __init__(self, groups: int, dim: int):
        self.sums, self.counts = np.zeros((groups, dim), np.int64), np.zeros(groups, np.int64)

    def add(self, rows: np.ndarray, group: np.ndarray) -> None:
        if len(group):
            order = np.argsort(group, kind="stable")
            held, first, count = np.unique(group[order], return_index=True, return_counts=True)
            self.sums[held] += np.add.reduceat(rows[order], first, axis=0)
            self.counts[held] += count

    def batch(self) -> pa.RecordBatch:
        """(g, at, total, n): a row for each component of the groups in use."""
        used, dim = np.flatnonzero(self.counts), self.sums.shape[1]
        columns = np.repeat(used, dim), np.tile(np.arange(dim), len(used)), self.sums[used].ravel(), np.repeat(self.counts[used], dim)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g", "at", "total", "n"])


def group_means(q: DataFrame, groups: int, dim: int, assign: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """floor(sum / count) of every group in use. assign gives (rows, their groups) for a
    batch of q. A task hands on its sums only; what comes to the driver is one number
    for each component of each group, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(groups, dim)
        for batch in batches:
            for rows, group in assign(batch):
                sums.add(rows, group)
        yield sums.batch()

    parts = q.mapInArrow(run, "g bigint, at bigint, total bigint, n bigint")
    found: dict[int, np.ndarray] = {}
    for g, at, total, n in parts.groupBy("g", "at").agg(F.sum("total"), F.sum("n")).collect():
        found.setdefault(g, np.zeros(dim, np.int64))[at] = total // n
    return found
