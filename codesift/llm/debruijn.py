"""Removal of long passages that repeat across documents, over a De Bruijn graph of words.

Thirteen consecutive words are an edge between the twelve-word nodes at their ends.  Consecutive edges of a text
with the same least 5-word shingle (the anchor) travel as one piece: equal edges have equal anchors, so everything
that can be equal meets under one anchor, and edges whose anchor occurs in one document only are left out early.
Pieces that are the same everywhere stay whole; where texts branch, a piece falls into its edges.  Joins at nodes
with one way in and one way out put pieces together to paths.  Spans of a path point to the smallest document
that has them, and the words at both coordinates are compared before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F

from . import shipped
from .scanned import Powers, chunks
from .store import Workspace
from .words import Chunk, binary, covered, windows

shipped(__name__)

EDGE = 13
ANCHOR = 5


def anchors(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the edges of a chunk, and the anchor of each: the least shingle hash inside it."""
    at = np.flatnonzero(c.whole(EDGE))
    if not len(at):
        return at, np.empty(0, np.uint64)
    return at, sliding_window_view(windows(c.h, ANCHOR), EDGE - ANCHOR + 1).min(axis=1)[at]


def _row() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text"]


def anchor_table(docs: DataFrame) -> DataFrame:
    """anchor, doc_id: the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for c in chunks(batch, powers, lower=False):
                at, least = anchors(c)
                doc = c.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                doc, least = doc[new], least[new]
                by = np.lexsort((least, doc))
                doc, least = doc[by], least[by]
                new = np.ones(len(by), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[new].view(np.int64)), pa.array(ids[np.array(c.rows)][doc[new]])], names=["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


PIECE = "doc_id long, row long, anchor long, piece long, start int, n int, first long, last long, edges array<long>"


def piece_table(texts: DataFrame) -> DataFrame:
    """texts(doc_id, row, text, anchors) -> the pieces under these anchors: name, place, end nodes and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            asked = batch.column("anchors")
            for c in chunks(batch, powers, lower=False):
                at, least = anchors(c)
                doc = c.doc[at]
                wanted = np.zeros(len(at), bool)
                ends = np.searchsorted(doc, np.arange(len(c.rows) + 1))
                for i, r in enumerate(c.rows):
                    span = slice(ends[i], ends[i + 1])
                    hits = np.sort(asked[r].values.to_numpy().view(np.uint64))
                    found = np.minimum(np.searchsorted(hits, least[span]), len(hits) - 1)
                    wanted[span] = hits[found] == least[span]
                at, least, doc = at[wanted], least[wanted], doc[wanted]
                if not len(at):
                    continue
                edge, node = windows(c.h, EDGE), windows(c.h, EDGE - 1)
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(at)))
                values = edge[at]
                names = [xxhash.xxh3_64_intdigest(values[b:b + k].tobytes()) for b, k in zip(begin.tolist(), n.tolist())]
                d, start = doc[begin], at[begin]
                r = np.array(c.rows)[d]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[r]), pa.array(keys[r]), pa.array(least[begin].view(np.int64)),
                    pa.array(np.array(names, np.uint64).view(np.int64)), pa.array((start - c.begin[d]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(node[start].view(np.int64)),
                    pa.array(node[start + n].view(np.int64)),
                    pa.ListArray.from_arrays(np.append(begin, len(at)).astype(np.int32), values.view(np.int64))],
                    names=["doc_id", "row", "anchor", "piece", "start", "n", "first", "last", "edges"])

    return texts.mapInArrow(run, PIECE)


def paths(pieces: DataFrame, work: Workspace) -> DataFrame:
    """pieces(piece, first, last, n), distinct -> piece, path, place: the path it lies on and how many edges before it.

    A piece follows another when it is the only one that begins at its node and the other the only one that ends
    there.  The way back to the head of a path is found by doubling: as many joins as the length has digits, each over
    the pieces that have not found it; when a round finds no head, none is left to find.
    """
    goes_in = pieces.groupBy(F.col("last").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("piece").alias("before"), F.min("n").alias("n"))
    goes_out = pieces.groupBy(F.col("first").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("piece").alias("piece"))
    link = goes_in.join(goes_out, "node").filter("ins = 1 and outs = 1 and before <> piece").select("piece", "before", F.col("n").cast("long").alias("n"))
    back = pieces.select("piece").join(link, "piece", "left")
    back = back.select("piece", F.coalesce("before", "piece").alias("path"), F.coalesce("n", F.lit(0)).alias("place"),
                       F.col("before").isNull().alias("done"))
    back = work.put(back, "back0")
    open_, ended, turn = back.filter("not done"), back.filter("done"), 0
    while True:
        above = ended.union(open_).select(F.col("piece").alias("path"), F.col("path").alias("path2"), F.col("place").alias("more"), F.col("done").alias("done2"))
        turn += 1
        nxt = work.put(open_.drop("done").join(above, "path").select(
            "piece", F.col("path2").alias("path"), (F.col("place") + F.col("more")).alias("place"), F.col("done2").alias("done")), f"back{turn}")
        found = nxt.filter("done")
        if found.isEmpty():  # what is left has no head: rings, each piece a path of its own
            return ended.union(open_.select("piece", F.col("piece").alias("path"), F.lit(0).cast("long").alias("place"), "done")).drop("done")
        ended, open_ = ended.union(found), nxt.filter("not done")


def repeated_spans(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs(doc_id, row, text) -> doc_id, row, start, n_words, source_id, source_row, source_start, path.

    Spans of words whose windows all start in the smallest document with them, source_id < doc_id, as well.
    """
    seen = work.put(anchor_table(docs), "anchors")
    common = seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    hits = seen.join(common.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    hits = work.put(hits, "hits")
    work.drop("anchors")
    pieces = work.put(piece_table(docs.join(hits, "doc_id").select("doc_id", "row", "text", "anchors")), "pieces")
    work.drop("hits")
    place = F.struct("row", "start")
    by_anchor = pieces.groupBy("anchor").agg(
        F.min("piece").alias("low"), F.max("piece").alias("high"), F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id"))
    by_anchor = work.put(by_anchor.filter("source_id < last_id").select(
        "anchor", (F.col("low") == F.col("high")).alias("same"), "source_id"), "by_anchor")
    # pieces that are the same in all documents
    whole = pieces.drop("edges").join(by_anchor.filter("same"), "anchor")
    whole = work.put(whole, "whole")
    origin = whole.filter("doc_id = source_id").groupBy("piece").agg(F.min(place).alias("at"))
    kinds = whole.groupBy("piece").agg(*[F.any_value(c).alias(c) for c in ("first", "last", "n")])
    path = work.put(paths(kinds, work), "paths")
    # written, so that both sides of the next join are plain and a very common piece can be split over tasks
    told = work.put(origin.join(path, "piece").select("piece", "path", "place", F.col("at.row").alias("source_row"), F.col("at.start").alias("source_start")), "told")
    whole = whole.filter("doc_id > source_id").join(told, "piece").select(
        "doc_id", "row", "start", "n", "source_id", "source_row", "source_start", "path")
    # edges of the pieces that branch
    edges = pieces.join(by_anchor.filter("not same").select("anchor"), "anchor").select(
        "doc_id", "row", "start", F.posexplode("edges").alias("k", "edge")).select(
        "edge", "doc_id", "row", (F.col("start") + F.col("k")).alias("start"))
    edges = work.put(edges, "edges")
    work.drop("pieces", "by_anchor")
    first = edges.groupBy("edge").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id"))
    first = work.put(first.filter("source_id < last_id").select("edge", "source_id"), "sources")
    single = work.put(edges.join(first, "edge"), "single")
    work.drop("edges", "sources")
    origin = work.put(single.filter("doc_id = source_id").groupBy("edge").agg(
        F.min("start").alias("source_start"), F.min_by("row", "start").alias("source_row")), "origins")
    single = single.filter("doc_id > source_id").join(origin, "edge").select(
        "doc_id", "row", "start", F.lit(1).alias("n"), "source_id", "source_row", "source_start", F.lit(None).cast("long").alias("path"))
    # neighbours in the document that are neighbours in the source as well become one span
    rows = whole.unionByName(single)
    order = Window.partitionBy("doc_id", "row").orderBy("start", "source_row", "source_start")
    follows = F.lag(F.struct((F.col("start") + F.col("n")).alias("end"), "source_id", "source_row",
                             (F.col("source_start") + F.col("n")).alias("source_end"))).over(order)
    rows = rows.withColumn("begins", (~F.struct(
        F.col("start").alias("end"), "source_id", "source_row", F.col("source_start").alias("source_end")).eqNullSafe(follows)).cast("int"))
    rows = rows.withColumn("number", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy("doc_id", "row", "number").agg(
        F.min("start").alias("start"), (F.sum("n") + (EDGE - 1)).cast("int").alias("n_words"), F.any_value("source_id").alias("source_id"),
        F.any_value("source_row").alias("source_row"), F.min("source_start").alias("source_start"), F.min("path").alias("path"))
    spans = work.put(spans.drop("number").distinct(), "spans")
    work.drop("whole", "told", "paths", "single", "origins", *[f"back{i}" for i in range(50)])
    return verified(spans, docs, work)


def verified(spans: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """The spans whose words are the same at both coordinates."""
    here = spans.select("doc_id", "row", "start", "n_words")
    there = spans.select(F.col("source_id").alias("doc_id"), F.col("source_row").alias("row"), F.col("source_start").alias("start"), "n_words")
    asked = here.union(there).distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n_words")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (d, r, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), binary(batch, "text"))):
                words = text.split()
                for x in batch.column("asked")[i].as_py():
                    s, n = x["start"], x["n_words"]
                    for column, value in zip(out, (d, r, s, n, xxhash.xxh3_128_digest(b" ".join(words[s:s + n])))):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             names=["doc_id", "row", "start", "n_words", "digest"])

    # equal rows have the same words
    told = docs.join(asked, ["doc_id", "row"]).mapInArrow(run, "doc_id long, row long, start int, n_words int, digest binary").distinct()
    told = work.put(told, "digests")
    source = told.select(F.col("doc_id").alias("source_id"), F.col("row").alias("source_row"), F.col("start").alias("source_start"),
                         "n_words", F.col("digest").alias("source_digest"))
    return work.put(spans.join(told, ["doc_id", "row", "start", "n_words"]).join(
        source, ["source_id", "source_row", "source_start", "n_words"]).filter("digest = source_digest").select(
        "doc_id", "row", "start", "n_words", "source_id", "source_row", "source_start", "path"), "verified")


def without_repeats(docs: DataFrame, work: Workspace, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> per document doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept text.

    A word goes when a window of 13 words covers it whose words also start a window in a document with a smaller
    doc_id.  Null and empty texts have no words; what is shorter than a window stays.  A document whose doc_id is
    null has no smaller one and is none, so it stays whole.  Rows with one doc_id are not smaller than each
    other.
    """
    rows = docs.select(*_row())
    spans = repeated_spans(rows.filter("doc_id is not null and text is not null"), work)
    spans = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:5 if texts else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            total, removed, digest, kept = [], [], [], []
            for text, own in zip(binary(batch, "text"), spans):
                words = text.split() if text else []
                if own:
                    gone = covered(len(words), np.array([x["start"] for x in own]), np.array([x["n_words"] for x in own]))
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                data = b" ".join(left)
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(data).hexdigest())
                kept.append(data.decode())
            out = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.string())] if texts else []), names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return rows.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
