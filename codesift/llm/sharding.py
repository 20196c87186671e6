"""Uniform shuffle into shards of exact sizes with a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .ranks import ranked, unit
from .store import Workspace

# production parameters
SHARDS = 16
SEED = 77
ROWS_PER_BLOCK = 2048
MOST_BLOCKS = 8192  # bound of the matrix the driver draws, whatever the number of rows
ROWS_PER_CELL = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw: how many of ``draws`` rows taken without replacement are good; any size of numbers.

    Inverts the distribution function around the mode; what lies beyond 12 deviations has less weight than the
    rounding of the sums.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    spread = (mean * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    a, b = max(low, int(mean - 12 * spread) - 12), min(high, int(mean + 12 * spread) + 12)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log((good - x) * (draws - x)) - np.log((x + 1) * (bad - draws + x + 1))
    weight = np.concatenate([[0.0], np.cumsum(step)])
    total_weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(total_weight, rng.random() * total_weight[-1], side="right").clip(0, b - a))


def matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each block go to each shard, as a uniform shuffle would send them.

    Row sums are the block sizes, column sums the shard sizes, which differ by one at most.
    """
    rng, total = np.random.default_rng(seed), sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            out[p, s] = k = hypergeometric(rng, left[s], rest, n)
            n -= k
            left[s] -= k
    return out


def sharded(docs: DataFrame, work: Workspace, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, and the carried columns.

    Rows fall into blocks by a hash; the matrix says how many rows of a block each shard gets; the rows of a
    block are permuted and dealt out by these counts, exchanged, and permuted again inside their shard.  Only
    counts reach the driver: a number for each block, of which there are at most MOST_BLOCKS.

    size is the UTF-8 bytes of the text plus one; a null text has no bytes and the CRC of the empty text.  A null
    doc_id is carried through; repeated rows are rows of their own.  Equal rows are interchangeable, every other
    tie is decided, so reruns agree.  The law is ``rows``: counts of shards differ by one at most.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    kept = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                         F.xxhash64(F.lit(seed), "doc_id", "text", F.hash("text")).alias("h"), *kept)
    narrow = work.put(narrow, "narrow")
    total = narrow.count()
    blocks = min(MOST_BLOCKS, -(-total // ROWS_PER_BLOCK)) or 1
    narrow = narrow.withColumn("block", F.pmod("h", F.lit(blocks)))
    counted = sorted((r["block"], r["n"]) for r in narrow.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())
    upto = np.cumsum(matrix([n for _, n in counted], shards, seed), axis=1)
    dealt = docs.sparkSession.createDataFrame(
        [(b, row.tolist()) for (b, _), row in zip(counted, upto)], "block long, upto array<long>")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "h", "doc_id", "text_crc32")
    out = narrow.withColumn("place", F.row_number().over(local) - 1).join(dealt, "block")
    out = out.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("place")))).drop("block", "place", "upto")
    out = work.put(out.withColumn("again", F.xxhash64(F.lit(seed + 2), "h")), "exchanged")
    cells = max(1, -(-total // (shards * ROWS_PER_CELL)))
    out = ranked(out, ["shard"], F.floor(unit(F.col("again")) * cells),
                 [F.col("again"), F.col("h"), F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"),
                      *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry) if c not in ("doc_id", "size")])
