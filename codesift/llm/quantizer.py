"""Vector codes of four bytes: product quantisation whose members stay with the owner of their entry.

A vector is cut into parts, and a part lives in the partition of (position, entry, salt), where entry is the codebook
entry it was last assigned to.  The owner of a partition measures its resident parts against the codebook of their
position and adds up what its entry and the others get.  Only parts that change their entry go through the next shuffle,
to the partition of the new one; all others stay, since the union of two data sets dealt out by one partitioner moves
nothing.  This is what a fixed partitioner of an RDD expresses and a DataFrame cannot, so the rounds work on RDDs of
packed NumPy blocks.  The salt spreads an entry with very many parts over as many owners as its share needs.

All numbers are exact: products of doubles where they cannot lose a bit, Python integers elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .store import Workspace, checkpointed
from .vectors import finite, long_or_null, matrix, whole_numbers
from .words import mix

shipped(__name__)

# production parameters
PARTS = 4
ENTRIES = 256
ROUNDS = 4
MEMBERS = 1 << 16  # parts that one owner holds on average, at most
SLICE = 4096  # parts measured at a time
EXACT = 1 << 53


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance; ties go to the lower entry."""
    small = x.dtype != object and book.dtype != object
    if small:
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
        small = 4 * book.shape[1] * top * top < EXACT
    x, book = (x.astype(np.float64), book.astype(np.float64)) if small else (x.astype(object), book.astype(object))
    entry, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    size = (book * book).sum(axis=1)
    for a in range(0, len(x), SLICE):
        some = x[a:a + SLICE]
        d = size - 2 * (some @ book.T)
        entry[a:a + SLICE] = at = d.argmin(axis=1)
        best[a:a + SLICE] = d[np.arange(len(some)), at] + (some * some).sum(axis=1)
    return entry, best.astype(np.int64) if small else best


def resident(owner: int) -> int:
    """The partition function of all rounds: blocks already carry the number of their partition."""
    return owner


def owners(position: int, entry: np.ndarray, rows: np.ndarray, salts: int, partitions: int) -> np.ndarray:
    """The partition of (position, entry, salt)."""
    salt = mix(rows.astype(np.uint64), position) % np.uint64(salts)
    key = (np.uint64(position * ENTRIES) + entry.astype(np.uint64)) * np.uint64(salts) + salt
    return (mix(key, 99) % np.uint64(partitions)).astype(np.int64)


def dealt(position: int, entry: np.ndarray, rows: np.ndarray, x: np.ndarray, salts: int, partitions: int) -> Iterator[tuple[int, bytes]]:
    """One block for each partition that gets some of these parts."""
    to = owners(position, entry, rows, salts, partitions)
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.diff(to[order], append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        some = order[a:b]
        yield int(to[order[a]]), pickle.dumps((position, entry[some].astype(np.uint16), rows[some], x[some]), 5)


def gathered(blocks: Iterable[bytes]) -> Iterator[tuple]:
    """The parts of a partition by position: (position, entries, rows, parts)."""
    by: dict[int, list] = {}
    for data in blocks:
        position, *arrays = pickle.loads(data)
        by.setdefault(position, []).append(arrays)
    for position in sorted(by):
        yield position, *[np.concatenate(column) for column in zip(*by[position])]


def moving(books: list[np.ndarray], salts: int, partitions: int):
    """One round of an owner: (owner, (kind, block)) of what stays, what moves, and the sums for each entry."""
    def run(number: int, blocks: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, tuple[str, bytes]]]:
        for position, old, rows, x in gathered(data for _, data in blocks):
            entry, _ = nearest(x, books[position])
            stays = entry == old
            if stays.any():
                yield number, ("stay", pickle.dumps((position, old[stays], rows[stays], x[stays]), 5))
            leaves = ~stays
            for to, data in dealt(position, entry[leaves], rows[leaves], x[leaves], salts, partitions):
                yield to, ("move", data)
            order = np.argsort(entry, kind="stable")
            used, begin, n = np.unique(entry[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], begin, axis=0)
            yield number, ("sums", pickle.dumps([(position, int(e), int(c), [int(v) for v in s]) for e, c, s in zip(used, n, sums)], 5))
    return run


def added(a: dict, b: dict) -> dict:
    """Sums by (position, entry): at most parts x entries of them."""
    for key, (n, s) in b.items():
        m, t = a.get(key, (0, [0] * len(s)))
        a[key] = m + n, [x + y for x, y in zip(t, s)]
    return a


def totals(stepped: RDD) -> dict:
    """The sums of all owners, merged in a tree of tasks; the driver gets one table of fixed size from each last one."""
    def of_task(rows: Iterator) -> Iterator[dict]:
        out: dict = {}
        for _, (kind, data) in rows:
            if kind == "sums":
                added(out, {(p, e): (n, s) for p, e, n, s in pickle.loads(data)})
        yield out
    return stepped.mapPartitions(of_task).treeReduce(added, 3)


def updated(books: list[np.ndarray], sums: dict) -> list[np.ndarray]:
    """Each used entry becomes the floor of its mean, exactly; the others stay."""
    out = []
    for position, book in enumerate(books):
        rows = [list(map(int, r)) for r in book]
        for entry in range(len(rows)):
            if (position, entry) in sums:
                n, s = sums[position, entry]
                rows[entry] = [v // n for v in s]
        out.append(whole_numbers(rows, book.shape[1]))
    return out


def fitted(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], RDD]:
    """rows(row, vec_id, embedding), written -> the codebooks, and where each part is: RDD of (owner, block)."""
    spark, cut = rows.sparkSession, width // parts
    first = rows.filter("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).select("embedding").toArrow()
    first = first.combine_chunks().to_batches()
    if not first:
        return [], spark.sparkContext.emptyRDD()
    start = matrix(first[0], "embedding", width)
    books = [whole_numbers([list(map(int, r)) for r in start[:, p * cut:(p + 1) * cut]], cut) for p in range(parts)]
    n = rows.count()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // MEMBERS))
    salts = 1 + n // (MEMBERS // 4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch, "embedding", width), batch.column("row").to_numpy()
            for p in range(parts):
                piece = np.ascontiguousarray(x[:, p * cut:(p + 1) * cut])
                blocks = list(dealt(p, nearest(piece, books[p])[0], ids, piece, salts, partitions))
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in blocks], pa.int64()), pa.array([b for _, b in blocks], pa.binary())],
                                                 names=["owner", "data"])

    blocks = rows.select("row", "embedding").mapInArrow(deal, "owner long, data binary")
    members = blocks.rdd.map(tuple).partitionBy(partitions, resident)
    partitions = members.getNumPartitions()
    for _ in range(rounds):
        # the checkpoint cuts the lineage; what is persisted only feeds it
        stepped = members.mapPartitionsWithIndex(moving(books, salts, partitions), True).persist(StorageLevel.MEMORY_AND_DISK)
        checkpointed(stepped)
        books = updated(books, totals(stepped))
        stepped.unpersist()
        stay = stepped.filter(lambda r: r[1][0] == "stay").mapPartitions(lambda it: ((k, d) for k, (_, d) in it), True)
        move = stepped.filter(lambda r: r[1][0] == "move").mapValues(lambda v: v[1]).partitionBy(partitions, resident)
        members = stay.union(move)  # one partitioner: what stays is not shuffled
    return books, members


def coded(vectors: DataFrame, work: Workspace, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256 per kept vector.

    Dropped are rows whose vector is null or has a null or non-finite component.  All codes need one length that can
    be cut into ``parts``: that of the kept vector with the smallest vec_id that can; kept vectors of another length
    have a null code and error.  Repeated rows count each; a row with a null vec_id is coded but starts no codebook;
    fewer rows than ``entries`` start smaller codebooks; without any the codes are null.  A label_error without any error
    is null, and so are an error or a sum beyond a long.  Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").filter(finite(F.col("embedding")))
    rows = work.put(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    usable = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    smallest = rows.filter(usable & F.col("vec_id").isNotNull()).orderBy("vec_id", "embedding").select(F.size("embedding")).first()
    if smallest is None:
        books, members = [], spark.sparkContext.emptyRDD()
    else:
        books, members = fitted(rows.filter(F.size("embedding") == smallest[0]), smallest[0], parts, entries, rounds)

    def last(blocks: Iterator[tuple[int, bytes]]) -> Iterator[tuple[bytes]]:
        for position, _, ids, x in gathered(data for _, data in blocks):
            entry, d = nearest(x, books[position])
            yield (pickle.dumps((position, ids, entry, d), 5),)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                position, ids, entry, d = pickle.loads(data.as_py())
                d = pa.array([str(int(v)) for v in d], pa.string()) if d.dtype == object else pa.array(d).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), position), pa.int32()), pa.array(entry, pa.int32()), d],
                    names=["row", "position", "entry", "d"])

    found = spark.createDataFrame(members.mapPartitions(last), "data binary").mapInArrow(
        unpacked, "row long, position int, entry int, d string")
    digits = [F.max(F.when(F.col("position") == p, F.lpad(F.lower(F.hex("entry")), 2, "0"))) for p in range(parts)]
    codes = work.put(found.groupBy("row").agg(F.concat(*digits).alias("code"), long_or_null(
        F.sum(F.col("d").try_cast("decimal(38,0)"))).alias("error")), "codes")
    told = work.put(rows.drop("embedding").join(codes, "row", "left"), "told")
    by_label = work.put(told.groupBy("label").agg(long_or_null(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "labels")
    text = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    out = told.join(by_label.withColumnRenamed("label", "of_label"), F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle(width: int = 64) -> str:
    """The same in SQL for vectors of one length: every part against every entry, round by round."""
    cut = width // PARTS
    measure = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT x.rid, x.p, min(struct_pack(d := {measure}, e := c.e)) AS best FROM parts x JOIN c{r} c ON c.p = x.p GROUP BY x.rid, x.p)"""

    def update(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT a.p, a.best.e AS e, g.i, sum(x.v[g.i]) AS s, count(*) AS n
      FROM a{r} a JOIN parts x ON x.rid = a.rid AND x.p = a.p, range(1, {cut + 1}) g(i) GROUP BY a.p, a.best.e, g.i) GROUP BY p, e) m
  ON m.p = c.p AND m.e = c.e)"""

    steps = [step for r in range(ROUNDS) for step in (assign(r), update(r))] + [assign(ROUNDS)]
    code = " || ".join(f"max(CASE WHEN a.p = {p} THEN lower(printf('%02x', CAST(a.best.e AS INTEGER))) END)" for p in range(PARTS))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[{cut} * p + 1:{cut} * p + {cut}] AS v FROM kept, range({PARTS}) g(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT a.rid, {code} AS code, sum(a.best.d) AS error FROM a{ROUNDS} a GROUP BY a.rid)
SELECT k.vec_id, d.code, CAST(d.error AS BIGINT) AS error, CAST(sum(d.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN coded d ON d.rid = k.rid"""


ORACLE = _oracle()
