"""Updates and look-ups on immutable tables: newest row per key, update by key, insert if absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def newest(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order.

    An aggregate, not a window: rows of a hot key are combined before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def oldest(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def update_by_key(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str], keep_null: bool = True) -> DataFrame:
    """Rows of ``target`` with the columns of ``changes`` written over them.

    Changes may come more than once: the last one of a key in the given order counts (other columns decide ties),
    so the target never gains a row.  With ``keep_null`` a null in the change is written; otherwise it leaves the
    old value in place.
    """
    columns = [c for c in changes.columns if c != key]
    last = newest(changes, key, [*order, *[c for c in columns if c not in order]])
    new = last.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed"))
    joined = target.join(new, key, "left")

    def value(c: str):
        if c not in columns:
            return F.col(c)
        written = F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c))
        return (written if keep_null else F.coalesce(F.col(f"_new_{c}"), F.col(c))).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is new; the first one of each key in the given order."""
    return oldest(incoming, key, order).join(target.select(key), key, "left_anti").select(*incoming.columns)
