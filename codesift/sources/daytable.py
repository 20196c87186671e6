"""A table of rows by day whose changes are committed: only days with a changed row are written again.

    data/version=V/day=D/...    the rows of day D as version V wrote them
    manifest/N.json             version N: the folders that make up the table, and what has been applied to it

A change writes new folders beside the old ones and then publishes a manifest by renaming it into place, so readers see
the whole change or nothing, and files of other days keep their names.  The driver handles folder names, one or a few
for each day; rows stay with the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

NO_DAY = "none"


class DayTable:
    """The newest version of the table at ``path``; rows belong to the day of ``time``, those without to a day of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, time: str = "created_at"):
        self.spark, self.path, self.schema, self.key, self.time = spark, path.rstrip("/"), schema, key, time
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    # ---- versions ------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``folders`` and ``applied`` of a version, the newest one by default."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "folders": [], "applied": {}}
        at = f"{self.path}/manifest/{known[-1] if version is None else version}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(at, wholetext=True).collect()))

    def _publish(self, before: dict, folders: Iterable[str], applied: dict) -> int:
        version = before["version"] + 1
        new = {"version": version, "folders": sorted(folders), "applied": applied}
        wait, target = self._hadoop(f"{self.path}/manifest/_{version}"), self._hadoop(f"{self.path}/manifest/{version}.json")
        self._fs.mkdirs(wait.getParent())
        out = self._fs.create(wait, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(wait, target):
            raise RuntimeError(f"version {version} was published by another writer; read the table again and repeat the change")
        return version

    # ---- reading -------------------------------------------------------------
    def _rows(self, folders: list[str]) -> DataFrame:
        placed = T.StructType([*self.schema.fields, T.StructField("version", T.IntegerType()), T.StructField("day", T.StringType())])
        if not folders:
            return self.spark.createDataFrame([], placed)
        root = f"{self.path}/data"
        return self.spark.read.schema(placed).option("basePath", root).parquet(*[f"{root}/{f}" for f in folders])

    def read(self, days: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of some days, or of all."""
        wanted = None if days is None else set(days)
        folders = [f for f in self.manifest(version)["folders"] if wanted is None or _day(f) in wanted]
        return self._rows(folders).select(*self.schema.names)

    # ---- changing ------------------------------------------------------------
    def _write(self, rows: DataFrame, version: int, days: int) -> list[str]:
        """Folders of the rows, each written by the day's share of the tasks of a shuffle."""
        at = f"{self.path}/data/version={version}"
        share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, days))
        day = F.coalesce(F.date_format(self.time, "yyyy-MM-dd"), F.lit(NO_DAY))
        placed = rows.select(*self.schema.names).withColumns({"day": day, "_part": F.pmod(F.xxhash64(self.key), F.lit(share))})
        placed.repartition("day", "_part").drop("_part").write.mode("overwrite").partitionBy("day").parquet(at)
        return [f"version={version}/{s.getPath().getName()}" for s in self._fs.listStatus(self._hadoop(at)) if s.isDirectory()]

    def _applied(self, now: dict, batch: tuple[str, int] | None) -> dict | None:
        """What will have been applied, or None when the batch was before."""
        if batch is None:
            return now["applied"]
        name, n = batch
        return None if now["applied"].get(name, -1) >= n else now["applied"] | {name: n}

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows; no file is written again.  A ``batch`` (of a source, with its number) counts once.  Returns the version."""
        now = self.manifest()
        applied = self._applied(now, batch)
        if applied is None:
            return now["version"]
        days = rows.select(F.to_date(self.time).alias("day")).distinct().count()
        return self._publish(now, now["folders"] + self._write(rows, now["version"] + 1, days), applied)

    def update(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """``apply(rows, changes)`` on the days that hold a changed key, which alone are read whole and written again.

        changes must hold the table's key.  What ``apply`` adds goes to its own day.  Changes of unknown keys touch no day.
        """
        now = self.manifest()
        applied = self._applied(now, batch)
        if applied is None:
            return now["version"]
        keys = changes.select(self.key).distinct()
        # keys only are read here
        touched = {r["day"] for r in self._rows(now["folders"]).join(keys, self.key, "left_semi").select("day").distinct().collect()}
        if not touched:
            return now["version"] if batch is None else self._publish(now, now["folders"], applied)
        rows = self._rows([f for f in now["folders"] if _day(f) in touched]).select(*self.schema.names)
        written = self._write(apply(rows, changes), now["version"] + 1, len(touched))
        return self._publish(now, [f for f in now["folders"] if _day(f) not in touched] + written, applied)

    def clear(self, keep: int = 2) -> None:
        """Delete folders that none of the last ``keep`` versions needs, and older manifests."""
        versions = self.versions()
        kept = versions[-max(1, keep):]
        needed = {f for v in kept for f in self.manifest(v)["folders"]}
        for v in versions:
            if v in kept:
                continue
            for f in set(self.manifest(v)["folders"]) - needed:
                self._fs.delete(self._hadoop(f"{self.path}/data/{f}"), True)
        for v in versions:
            if v not in kept:
                self._fs.delete(self._hadoop(f"{self.path}/manifest/{v}.json"), False)


def _day(folder: str) -> str:
    return folder.rsplit("day=", 1)[1]
