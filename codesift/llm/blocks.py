"""Tables whose rows are packed NumPy arrays for one bucket of a key space, and messages between buckets.

A row is (bucket, kind, source, data, stats).  ``data`` holds arrays of one kind; ``stats`` a few numbers that the driver
may add up over all rows.  Buckets are as many as the data needs, so that the rows of one fit a task; a bucket
reads all its rows together, sorted by kind and source.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shipped

shipped(__name__)

SCHEMA = "bucket long, kind int, source long, data binary, stats array<long>"
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
NAMES = ["bucket", "kind", "source", "data", "stats"]
BATCH_BYTES = 1 << 24


def narrow(a: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    if a.dtype.kind not in "iu" or not a.size or a.min() < 0:
        return a
    return a.astype(np.min_scalar_type(a.max()))


def row(bucket: int, kind: int, source: int, *arrays: np.ndarray, stats: list[int] | None = None) -> tuple:
    return int(bucket), kind, int(source), pickle.dumps([narrow(a) for a in arrays], 5), stats


def batches_of(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[3])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), KINDS)], names=NAMES)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), KINDS)], names=NAMES)


Got = dict[int, list[tuple[int, list[np.ndarray]]]]


def grouped(df: DataFrame, buckets: int, work: Callable[[int, Got], Iterator], schema: str = SCHEMA) -> DataFrame:
    """``work(bucket, {kind: [(source, arrays)]})`` for every bucket; it yields rows, or Arrow batches of another schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield from batches_of(work(now, got)) if schema == SCHEMA else work(now, got)

        for batch in batches:
            for i, (bucket, kind, source) in enumerate(zip(*(batch.column(c).to_pylist() for c in NAMES[:3]))):
                if bucket != now:
                    yield from done()
                    now, got = bucket, {}
                got.setdefault(kind, []).append((source, pickle.loads(batch.column("data")[i].as_buffer())))
        yield from done()

    # two buckets a task, so that no task has many more than the others
    rows = df.select("bucket", "kind", "source", "data").repartition(1 + buckets // 2, "bucket").sortWithinPartitions("bucket", "kind", "source")
    return rows.mapInArrow(run, schema)


def of_kind(df: DataFrame, *kinds: int) -> DataFrame:
    return df.filter(F.col("kind").isin(*kinds))


def added(df: DataFrame, width: int) -> list[int]:
    """The stats of all rows, added up."""
    return [int(x or 0) for x in df.agg(*[F.sum(F.col("stats")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).first()]


def split(to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, arrays) for each bucket that gets something; the order inside a bucket is kept."""
    order = np.argsort(to, kind="stable")
    to, arrays = to[order], [a[order] for a in arrays]
    ends = np.flatnonzero(np.append(to[1:] != to[:-1], True)) + 1 if len(to) else np.empty(0, np.int64)
    begin = 0
    for end in ends.tolist():
        yield (int(to[begin]), *[a[begin:end] for a in arrays])
        begin = end


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours as one value and how often it stands there."""
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    return values[begin], np.diff(np.append(begin, len(values)))


def joined(parts: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    """Blocks of equal columns put together."""
    if not parts:
        return [np.empty(0, np.int64) for _ in range(columns)]
    return [np.concatenate([p[i] for p in parts]) for i in range(columns)]
