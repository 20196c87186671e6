"""Near-duplicate documents by circulant MinHash, banding and exact confirmation.

Two permutations make all signature coordinates (C-MinHash): the first places every shingle on a circle of 2**32
positions, the second, shifted by k places, gives coordinate k.  Both are bijective mixers, so nothing of the
size of the universe is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .components import components
from .store import Workspace
from .words import Chunk, WordHash, chunks, mix, windows

shipped(__name__)

SHINGLE = 5
PERCENT = 75
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 21, 2048  # of a bucket, held by a task at a time
BANDS, ROWS = 32, 4  # a pair at the limit shares no band with probability (1 - 0.75**4)**32 = 5e-6


def shingle_sets(chunk: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, one document after another, and where each ends.

    A document with fewer than k words has its whole sequence as its only shingle; one without words has none.
    """
    w, ok = windows(chunk.h, k), chunk.whole(k)
    doc = chunk.doc[:len(w)][ok]
    w = w[ok]
    short = np.flatnonzero((chunk.n > 0) & (chunk.n < k))
    if len(short):
        whole = np.array([windows(chunk.h[chunk.begin[i]:chunk.end[i]], int(chunk.n[i]))[0] for i in short], np.uint64)
        whole = mix(whole ^ mix(chunk.n[short].astype(np.uint64)))  # never equal to a shingle of k words
        doc, w = np.concatenate([doc, short]), np.concatenate([w, whole])
    order = np.lexsort((w, doc))
    doc, w = doc[order], w[order]
    new = np.ones(len(w), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])
    doc, w = doc[new], w[new]
    return w, np.cumsum(np.bincount(doc, minlength=len(chunk.n)))


def _permuted(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> None:
    """A bijection of the 32-bit numbers, in place."""
    np.right_shift(x, 16, out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, 13, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.right_shift(out, 16, out=tmp)
    np.bitwise_xor(out, tmp, out=out)


def signatures(shingles: np.ndarray, end: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Row per document with at least one shingle (in order), column per coordinate."""
    begin = np.concatenate([[0], end[:-1]])
    begin = begin[end > begin]
    place = mix(shingles, 1).astype(np.uint32)  # the first permutation, on the circle
    shifted, value, tmp = np.empty_like(place), np.empty_like(place), np.empty_like(place)
    out = np.empty((len(begin), coordinates), np.uint32)
    if not len(begin):
        return out
    for k in range(coordinates):
        np.subtract(place, np.uint32(k), out=shifted)  # the shift of the second one, modulo the circle
        _permuted(shifted, value, tmp)
        out[:, k] = np.minimum.reduceat(value, begin)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit key of each band of each document; the band is part of the key."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r], 2)
    return key


# ---- the operator ----------------------------------------------------------------
SKETCH = "doc_id long, key long, n_shingles long, set_id binary, bands array<long>"
SETS = "set_id binary, shingles array<long>"


def _set_ids(shingles: np.ndarray, end: np.ndarray) -> list[bytes | None]:
    """128-bit name of each set; documents with the same set have the same name, whatever their texts."""
    out, p = [], 0
    for e in end.tolist():
        out.append(xxhash.xxh3_128_digest(shingles[p:e].tobytes()) if e > p else None)
        p = e
    return out


def sketches(docs: DataFrame, key: str | None) -> DataFrame:
    """Per document: size and name of its shingle set and its band keys, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for c in chunks(batch, cache, lower=True):
                s, end = shingle_sets(c)
                size = np.diff(end, prepend=0)
                keys = band_keys(signatures(s, end)).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(x).take(pa.array(c.rows)) for x in ("doc_id", "key")], pa.array(size, pa.int64()),
                     pa.array(_set_ids(s, end), pa.binary()), pa.ListArray.from_arrays(offsets, keys.ravel())],
                    names=["doc_id", "key", "n_shingles", "set_id", "bands"])

    named = F.col(key) if key else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.cast("long").alias("key"), "text").mapInArrow(run, SKETCH)


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for c in chunks(batch, cache, lower=True):
                s, end = shingle_sets(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_ids(s, end), pa.binary()),
                     pa.ListArray.from_arrays(np.concatenate([[0], end]).astype(np.int32), s.view(np.int64))],
                    names=["set_id", "shingles"])

    return docs.select("text").mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of set names whose full sets reach the limit."""
    first = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either")).filter(
        100 * F.col("common") >= PERCENT * F.col("either")).select("a", "b")


def near_duplicates(docs: DataFrame, work: Workspace, key: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> per document doc_id, key, n_shingles, component_id, kept.

    ``key`` names a column to carry along, null if there is none.
    Documents with equal sets are one node.  Nodes that share a band are candidates.  A few rounds pair each node
    with a likely hub of its buckets and contract what is confirmed; then whatever shares a bucket and still
    lies in different components is compared, block against block inside tasks that emit links only, so the rounds
    save work and lose no link.

    Null and empty texts have the empty set and link with nothing; a document without words is its own component.
    A document whose doc_id is null takes part, but only other ids name a component; where there is none the
    component is null.  Repeated rows are equal documents.  kept is doc_id = component_id, nulls being equal.
    """
    all_docs = work.put(sketches(docs, key), "sketches")
    nodes = all_docs.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    nodes = work.put(nodes, "nodes")
    member = nodes.select("set_id", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = work.put(member.join(shared, "band"), "members")

    # full sets of the candidates only
    wanted = member.select("set_id").distinct()
    picked = nodes.join(wanted, "set_id", "left_semi").select("doc_id").distinct()
    null_ids = docs.filter("doc_id is null")  # few; taken as they are
    texts = docs.filter("doc_id is not null").select("doc_id", "text").join(picked, "doc_id", "left_semi").select(
        "text").union(null_ids.select("text"))
    sets = _full_sets(texts).join(wanted, "set_id", "left_semi")
    sets = work.put(sets.groupBy("set_id").agg(F.any_value("shingles").alias("shingles")), "sets")

    # first round: the node of each bucket with the most neighbours
    weight = member.groupBy("set_id").agg(F.sum("size").alias("weight"))
    weighed = work.put(member.join(weight, "set_id"), "weighed")
    hub = weighed.groupBy("band").agg(F.max(F.struct("weight", "set_id")).alias("hub"))
    best = weighed.join(hub, "band").groupBy("set_id").agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("set_id").alias("a"), F.col("hub.set_id").alias("b")).filter("a <> b")
    links = work.put(confirmed(pairs, sets), "links0")
    label = components(links, work, "round0")
    labelled = _labelled(member, label, work, "labelled0")
    # two rounds: other members of a bucket against one of its largest component, another one in each bucket
    for turn in (1, 2):
        mixed = labelled.groupBy("band", "label").agg(
            F.count(F.lit(1)).alias("many"),
            F.max_by("set_id", F.xxhash64("set_id", "band", F.lit(turn))).alias("one"))
        lead = mixed.groupBy("band").agg(F.max(F.struct("many", "label", "one")).alias("lead"), F.count(F.lit(1)).alias("parts"))
        pairs = labelled.join(lead.filter("parts > 1"), "band").filter("label <> lead.label").select(
            F.col("set_id").alias("a"), F.col("lead.one").alias("b")).distinct()
        label = _joined(work.put(confirmed(pairs, sets), f"links{turn}"), label, work, f"round{turn}")
        labelled = _labelled(member, label, work, f"labelled{turn}")
    # what is left: the members of a bucket that lie in different components.  Blocks of the rest meet each other and
    # blocks of the largest component, whose blocks never meet: a stray in a bucket of m members costs m rows
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"))
    open_bands = parts.groupBy("band").agg(F.max(F.struct("many", "label", "n")).alias("lead"), F.sum("many").alias("all"), F.sum("n").alias("size"),
                                           F.count(F.lit(1)).alias("labels")).filter("labels > 1")

    def blocks(members, shingles):
        return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(members / BLOCK_MEMBERS))

    open_bands = open_bands.select("band", F.col("lead.label").alias("lead"), blocks(F.col("lead.many"), F.col("lead.n")).alias("lead_blocks"),
                                   blocks(F.col("all") - F.col("lead.many"), F.col("size") - F.col("lead.n")).alias("rest_blocks"))
    open_ = labelled.join(open_bands, "band").withColumn("leads", F.col("label") == F.col("lead"))
    own = F.pmod(F.xxhash64("set_id"), F.when(F.col("leads"), F.col("lead_blocks")).otherwise(F.col("rest_blocks")))

    def each(blocks, meeting):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), meeting)

    meets = F.when(F.col("leads"), each("rest_blocks", lambda x: F.struct(F.lit(True).alias("led"), x.alias("i"), F.col("own").alias("j")))).otherwise(
        F.concat(each("rest_blocks", lambda x: F.struct(F.lit(False).alias("led"), F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))),
                 each("lead_blocks", lambda x: F.struct(F.lit(True).alias("led"), F.col("own").alias("i"), x.alias("j")))))
    open_ = work.put(open_.withColumn("own", own).select("band", "set_id", "label", F.explode(meets).alias("at")).select(
        "band", "set_id", "label", "at.*"), "open")
    short = sets.select("set_id", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("half"))
    pairs = open_.join(short, "set_id").groupBy("band", "led", "i", "j").applyInArrow(_links_inside, "a binary, b binary").distinct()
    label = _joined(work.put(confirmed(pairs, sets), "links3"), label, work, "round3")

    named = nodes.select("set_id", "doc_id").join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = named.join(smallest, "label").select("set_id", "component_id")
    result = all_docs.select("doc_id", "key", "n_shingles", "set_id").join(component, "set_id", "left").withColumn(
        "component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    result = result.select("doc_id", "key", "n_shingles", "component_id",
                           F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    result = work.put(result, "result")
    work.drop("sketches", "nodes", "members", "sets", "weighed", "open", *[f"links{i}" for i in range(4)],
              *[f"labelled{i}" for i in range(3)])
    return result


def _links_inside(group: pa.Table) -> pa.Table:
    """Pairs of a bucket in different components whose sets, by the upper half of each hash, reach the limit.

    Halves may agree by chance, which can only add a pair; the full sets decide afterwards.
    """
    label = np.unique(np.array(group.column("label").to_pylist(), object), return_inverse=True)[1]
    half = group.column("half").combine_chunks()
    size = half.value_lengths().to_numpy(zero_copy_only=False)
    element, owner = half.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    number = np.unique(element, return_inverse=True)[1]
    by = np.argsort(number, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(number))])
    posted, end = owner[by], np.cumsum(size)
    rest = np.flatnonzero(label != np.bincount(label).argmax())  # of two components one is not the largest
    a, b = [], []
    for i in rest.tolist():
        mine = number[end[i] - size[i]:end[i]]
        count = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(posted[at], minlength=len(size))
        for j in np.flatnonzero((100 * common >= PERCENT * (size[i] + size - common)) & (label != label[i])).tolist():
            a.append(i)
            b.append(j)
    names = group.column("set_id").to_pylist()
    pairs = [sorted((names[i], names[j])) for i, j in zip(a, b)]
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})


def _labelled(member: DataFrame, label: DataFrame, work: Workspace, name: str) -> DataFrame:
    joined = member.join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
    return work.put(joined.select("band", "set_id", "n", F.coalesce("label", "set_id").alias("label")), name)


def _joined(links: DataFrame, label: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Components after more links: those of the labels, carried over to the nodes."""
    names = label.withColumnRenamed("node", "a").withColumnRenamed("label", "la")
    edges = links.join(names, "a", "left").select("b", F.coalesce("la", "a").alias("a"))
    names = label.withColumnRenamed("node", "b").withColumnRenamed("label", "lb")
    edges = edges.join(names, "b", "left").select("a", F.coalesce("lb", "b").alias("b"))
    above = components(edges, work, name).select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = label.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = above.select(F.col("label").alias("node"), F.col("top").alias("label")).join(label.select("node"), "node", "left_anti")
    return work.put(moved.union(new), f"{name}-all")
