"""Columns of vectors in Arrow batches, as matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on together.
ROWS = 4096


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, not empty, and has no entry that is null, not a number or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(F.col(column).cast("array<double>"), bad))


def usual_length(counts: list[tuple[int, int]]) -> int:
    """The commonest length of (length, rows), the longer of two that are as common, 0 if there is none."""
    return max(((n, k) for k, n in counts), default=(0, 0))[1]


def matrix(col: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    """A column of lists, each of k numbers, as doubles."""
    return np.asarray(col.flatten().cast(pa.float64()), np.float64).reshape(-1, k)


def pieces(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def whole(x: np.ndarray, least: int, most: int) -> np.ndarray:
    """Floors as 64-bit integers, held between least and most."""
    x = np.floor(x)
    out = np.where(np.abs(x) < 2.0**62, x, 0).astype(np.int64)
    out[x >= most] = most
    out[x <= least] = least
    return out
