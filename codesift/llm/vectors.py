"""Vectors of embeddings as exact integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import shipped

shipped(__name__)

SCALE = 1024
SMALL = 1 << 26  # up to here, four times a squared distance over 64 components fits a long
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null and no non-finite component."""
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(good(x.cast("double")), F.lit(False)))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles: as longs if all are small, else as Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * SCALE)
    if not v.size or np.abs(v).max() <= SMALL:
        return v.astype(np.int64)
    whole = [int(c) * SCALE if abs(c) >= 1 << 53 else math.floor(c * SCALE) for c in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def whole_numbers(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows of Python integers as longs if all are small, else as they are."""
    out = np.empty((len(rows), width), object)
    for i, r in enumerate(rows):
        out[i] = r
    return out.astype(np.int64) if all(abs(c) <= SMALL for r in rows for c in r) else out


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """The integers of a column of vectors that all have one length."""
    values = batch.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(values.reshape(-1, width))


def same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def longs(values: np.ndarray) -> pa.Array:
    """Numbers that fit a long; null for those that do not."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if v <= LONG else None for v in values], pa.int64())


def long_or_null(total: Column) -> Column:
    """A sum of decimals as a long; null beyond."""
    return total.try_cast("long")
