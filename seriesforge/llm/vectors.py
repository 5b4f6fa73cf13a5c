"""Packing of vector tables into bounded matrices, for the two operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def width_of(df: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as filled up with zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width).copy()
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def packs(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A task's (id, extra, vector) rows as arrays of at most ``rows`` rows."""
    ids, extra, vectors, n = [], [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            ids.append(part.column(0).to_numpy())
            extra.append(part.column(1).to_numpy())
            vectors.append(matrix(part.column(2), width))
            n += part.num_rows
            while n >= rows:
                i, e, v = np.concatenate(ids), np.concatenate(extra), np.concatenate(vectors)
                yield i[:rows], e[:rows], v[:rows]
                ids, extra, vectors, n = [i[rows:]], [e[rows:]], [v[rows:]], n - rows
    if n:
        yield np.concatenate(ids), np.concatenate(extra), np.concatenate(vectors)
