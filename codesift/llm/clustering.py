"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first.  A vector walks along the list of its current centroid; when
it finds a closer one, it goes on with the list of that one, never measures a centroid twice, and stops as soon as
the next in the list is farther from the current centroid than twice its own distance: by the triangle inequality
none behind it can be closer or as close.  All numbers are exact integers, so distances and ties are exact.

The vectors are read where they lie, once a round, and never shuffled.  A task adds up its vectors by centroid; a few
merging tasks add these sums, of which the driver gets a fixed number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .store import Workspace
from .vectors import LONG, SCALE, finite, longs, matrix, same_kind, whole_numbers

shipped(__name__)

# production parameters
WIDTH = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
MERGING_TASKS = 32


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two arrays of integers."""
    a, b = same_kind(a, b)
    return ((a - b) ** 2).sum(axis=1)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each one the others, nearest first."""
    k = len(centroids)
    apart = np.stack([squared(np.repeat(centroids[i:i + 1], k, axis=0), centroids) for i in range(k)])
    lists = [sorted((j for j in range(k) if j != i), key=lambda j: (apart[i, j], j)) for i in range(k)]
    return apart, np.array(lists, np.int64).reshape(k, k - 1)


def orchard(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many distances were measured.

    Ties go to the smaller number.  The start, the centroid with the most similar length, only saves steps.
    """
    x, centroids = same_kind(x, centroids)
    n, k = len(x), len(centroids)
    apart, lists = neighbours(centroids)
    length = (centroids ** 2).sum(axis=1)
    by_length = np.argsort(length, kind="stable")
    now = by_length[np.minimum(np.searchsorted(length[by_length], (x ** 2).sum(axis=1)), k - 1)]
    best = squared(x, centroids[now])
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), now] = True
    place, measured = np.zeros(n, np.int64), n
    walking = np.arange(n if k > 1 else 0)
    while len(walking):
        other = lists[now[walking], place[walking]]
        near = (apart[now[walking], other] <= 4 * best[walking]).astype(bool)  # stop strictly beyond twice the distance
        walking, other = walking[near], other[near]
        place[walking] += 1
        new = ~seen[walking, other]
        rows, found = walking[new], other[new]
        seen[rows, found] = True
        d = squared(x[rows], centroids[found])
        measured += len(rows)
        closer = ((d < best[rows]) | ((d == best[rows]) & (found < now[rows]))).astype(bool)
        rows = rows[closer]
        now[rows], best[rows], place[rows] = found[closer], d[closer], 0
        walking = walking[place[walking] < k - 1]
    return now, best, measured


def _sums(centroids: np.ndarray):
    """Arrow batches of vectors -> for each centroid how many vectors it has and their sum, once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        count, total = [0] * k, [[0] * width for _ in range(k)]
        for batch in batches:
            x = matrix(batch, "embedding", width)
            nearest, _, _ = orchard(x, centroids)
            for j in range(k):
                mine = x[nearest == j]
                if len(mine):
                    count[j] += len(mine)
                    total[j] = [a + int(b) for a, b in zip(total[j], mine.sum(axis=0))]
        yield _partial(count, total)
    return run


def _merge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for j, n, sums in zip(*(batch.column(c).to_pylist() for c in ("cluster", "n", "sums"))):
                count[j] = count.get(j, 0) + n
                total[j] = [a + int(b) for a, b in zip(total.get(j, [0] * width), sums)]
        if count:
            size = max(count) + 1
            yield _partial([count.get(j, 0) for j in range(size)], [total.get(j, []) for j in range(size)])
    return run


#: sums travel as decimal numbers, exact at any size
PARTIAL = "cluster int, n long, sums array<string>"


def _partial(count: list[int], total: list[list[int]]) -> pa.RecordBatch:
    some = [j for j, n in enumerate(count) if n]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([count[j] for j in some], pa.int64()),
         pa.array([list(map(str, total[j])) for j in some], pa.list_(pa.string()))], names=["cluster", "n", "sums"])


def first_centroids(kept: DataFrame, centroids: int, seed: int, width: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest hash, in the order of the hashes; equal ids by components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id is not null").select(h.alias("h"), "embedding").orderBy("h", "embedding").limit(centroids)
    batch = rows.toArrow().combine_chunks().to_batches()
    return matrix(batch[0], "embedding", width) if batch else np.empty((0, width), np.int64)


def fitted(kept: DataFrame, centroids: int, rounds: int, seed: int, width: int) -> np.ndarray:
    """The centroids after some rounds; one without vectors stays where it is."""
    now = first_centroids(kept, centroids, seed, width)
    for _ in range(rounds if len(now) else 0):
        partial = kept.select("embedding").mapInArrow(_sums(now), PARTIAL)
        merged = partial.repartition(MERGING_TASKS).mapInArrow(_merge(width), PARTIAL).collect()  # at most tasks x centroids rows
        rows = [list(map(int, r)) for r in now]
        for j in range(len(rows)):
            mine = [r for r in merged if r["cluster"] == j]
            if mine:
                n = sum(r["n"] for r in mine)
                rows[j] = [sum(column) // n for column in zip(*(map(int, r["sums"]) for r in mine))]
        now = whole_numbers(rows, width)
    return now


def clustered(vectors: DataFrame, work: Workspace, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
              width: int = WIDTH) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per kept vector.

    Kept are vectors with exactly ``width`` components, none null or non-finite.  Repeated rows count each; a row with
    a null vec_id is assigned but never a first centroid; other columns are not read.  With fewer than ``centroids``
    kept vectors each is a first centroid; if no kept row has a vec_id, or the table is empty, there is no result.  A
    distance or a sum of distances beyond a long is null.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        finite(F.col("embedding")) & (F.size("embedding") == width))
    now = fitted(kept, centroids, rounds, seed, width)
    spark = vectors.sparkSession
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance, _ = orchard(matrix(batch, "embedding", width), now)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest, pa.int32()), longs(distance)],
                                             names=["vec_id", "cluster", "distance"])

    assigned = work.put(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    # one row for each centroid; a null distance makes the sums null
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
                                           F.every(F.col("distance").isNotNull()).alias("known")).collect()
    total = {r["cluster"]: int(r["total"]) if r["known"] and r["total"] <= LONG else None for r in sums}
    whole = sum(total.values()) if None not in total.values() else None
    whole = whole if whole is not None and whole <= LONG else None
    told = [(j, total[j], whole, hashlib.sha256(",".join(str(int(c)) for c in now[j]).encode()).hexdigest()) for j in total]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same in SQL: every vector against every centroid, round by round."""
    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT x.rid, arg_min(c.k, struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := c.k)) AS k
  FROM kept x, c{r} c GROUP BY x.rid)"""

    def update(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT a.k, p.i, sum(x.v[p.i]) AS s, count(*) AS n FROM a{r} a JOIN kept x ON x.rid = a.rid, range(1, {WIDTH + 1}) p(i) GROUP BY a.k, p.i)
    GROUP BY k) m ON m.k = c.k)"""

    steps = [step for r in range(ROUNDS) for step in (assign(r), update(r))] + [assign(ROUNDS)]
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS})),
{", ".join(steps)},
d AS MATERIALIZED (
  SELECT x.vec_id, c.k, c.v, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM a{ROUNDS} a JOIN kept x ON x.rid = a.rid JOIN c{ROUNDS} c ON c.k = a.k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM d"""


ORACLE = _oracle()
