"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import ranked, unit
from .store import Workspace

# production parameters
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2
SEED = 20240
ROWS_PER_CELL = 4096

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: the places where a word begins."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "\u0001"), "[^\u0001]", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, work: Workspace) -> DataFrame:
    """sizes(source, size) -> source, source_key, source_size, target.

    Sources in the order of their code points, null last, weigh 3, 1, 2, repeating.  Together they get 150 % of
    all sizes; a target stops at twice its source's size and the excess is shared again by weight, until none is
    above.  All targets below their limit are then one level times the weight; the level is found from sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
        "part", F.spark_partition_id().cast("long"))
    dealt = work.put(dealt, "sources")  # the parts are fixed from here on
    keyed = ranked(dealt.withColumn("all", F.lit(0)), ["all"], F.col("part"), [F.col("source").asc_nulls_last()], "source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_key") % len(WEIGHTS) + 1).cast("int"))
    keyed = work.put(keyed.select("source", "source_key", "source_size", weight.alias("weight")), "weights")
    total = keyed.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, F.col("source_size") * MOST
    while True:
        full = F.lit(level) * F.col("weight") > most
        row = keyed.agg(F.sum(F.when(full, most).otherwise(0)).alias("given"),
                        F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("weight")).first()
        if not row["weight"]:
            break
        new = (total * SHARE_PERCENT / 100 - row["given"]) / row["weight"]
        if new <= level:
            break
        level = new
    target = F.least(F.lit(level) * F.col("weight"), most.cast("double"))
    return keyed.select("source", "source_key", "source_size", target.alias("target"))


def mixed(docs: DataFrame, work: Workspace, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, copies, taken, and the carried columns.

    Every document of a source expects target / source_size copies.  Inside a source documents stand in the
    order of their size, so that the words taken keep to the target as well as the documents do; the expected
    copies are summed along that order from one random offset of the source, and a document is emitted once for
    each integer the sum passes.  Between two integers documents of nearly one size stand for each other, so the words
    taken are off the target by less than the size of the largest document.  The order ends with a hash of id and text,
    so reruns agree.

    A null text has size 0; a null source is a source; a null doc_id is carried through; repeated rows are
    documents of their own, and which of two equal rows comes first makes no difference.  Columns of other
    names are ignored unless carried.
    """
    kept = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                         F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"), *kept)
    narrow = work.put(narrow, "sizes")
    targets = work.put(source_targets(narrow.select("source", "size"), work), "targets")
    # a cell of the order: documents of one size, cut further by their hash where there are many
    many = narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("many"))
    many = many.select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("many") / ROWS_PER_CELL).alias("cuts"))
    cells = many.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    rows = narrow.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z", "source")
    rows = work.put(rows, "rows")
    cell = F.col("size") * (1 << 24) + F.floor(unit(F.col("h")) * F.col("cuts"))
    placed = ranked(rows, ["source_key"], cell, [F.col("h"), F.col("doc_id")], "place")
    placed = work.put(placed, "placed")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def crossed(start: Column) -> Column:
        return F.floor(each * (F.col("place") + 1) + start) - F.floor(each * F.col("place") + start)

    start = unit(F.xxhash64(F.lit(SEED + 1), "source_key"))  # the one random offset of a source
    out = placed.withColumn("copies", crossed(start).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                      *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry) if c not in ("doc_id",)])
