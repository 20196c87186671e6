"""Committed changes: only touched days are written again, readers see whole versions, batches count once."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from codesift.operators import jobs as J
from codesift.sources.daytable import DayTable
from codesift.streaming import streams as ST

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("id", T.LongType()), ("status", T.StringType()), ("attempts", T.IntegerType()), ("last_error", T.StringType()), ("result", T.StringType()),
    ("completed_at", T.TimestampNTZType()), ("processing_time_ms", T.IntegerType()), ("dlq_message_id", T.StringType()),
    ("created_at", T.TimestampNTZType()))])


def job(i, day, status="queued"):
    return (i, status, 0, None, None, None, None, "m", None if day is None else T0 + timedelta(days=day, hours=i % 24))


def filled(spark, tmp_path, n=60):
    table = DayTable(spark, str(tmp_path / "jobs"), SCHEMA, "id")
    table.append(spark.createDataFrame([job(i, i % 6) for i in range(n)] + [job(1000, None)], SCHEMA))
    return table


def files(table):
    return {f: {p.name for p in Path(table.path, "data", f).glob("*.parquet")} for f in table.manifest()["folders"]}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_a_change_writes_touched_days_only_and_comes_twice(spark, tmp_path):
    table = filled(spark, tmp_path)
    before, old, first = rows(table.read()), files(table), table.manifest()["version"]
    ends = spark.createDataFrame([(6, "{}", T0, 7, 2), (12, "{}", T0, 8, 1), (99_999, "{}", T0, 8, 1)],
                                 "id long, result string, completed_at timestamp_ntz, processing_time_ms int, attempts int")
    want = rows(J.finish(spark.createDataFrame(before, SCHEMA), ends))
    for _ in range(2):
        table.update(ends.union(ends), J.finish)
        assert rows(table.read()) == want != before
        new = files(table)
        assert {f: n for f, n in old.items() if "2024-01-01" not in f}.items() <= new.items()
        assert len(new) == len(old) == 7
    assert rows(table.read(version=first)) == before  # an older version is still whole
    assert rows(table.read(days=["2024-01-01"])) == [r for r in want if r[8] is not None and r[8] < T0 + timedelta(days=1)]
    table.update(spark.createDataFrame([(1000, 5, "x")], "id long, attempts int, last_error string"), J.fail)  # a row without a day
    assert table.read().filter("id = 1000").first()["status"] == "retrying"
    table.clear(1)
    assert table.read().count() == 61 and len(list(Path(table.path, "data").glob("version=*/day=2024-01-01"))) == 1


def test_batches_count_once_and_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = filled(spark, tmp_path, 12)
    new = spark.createDataFrame([job(500, 1), job(501, 40)], SCHEMA)
    assert table.append(new, ("sent", 0)) == table.append(new, ("sent", 0)) == 2
    assert table.read().count() == 15 and table.append(new.limit(0), ("sent", 1)) == 3
    stale = table.manifest()
    table.append(spark.createDataFrame([job(502, 2)], SCHEMA))
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(stale, stale["folders"], {})
    assert table.read().count() == 16
    nobody = spark.createDataFrame([(-5, 1)], "id long, attempts int")
    assert table.update(nobody, J.start) == 4 and table.update(nobody, J.start, ("started", 3)) == 5
    assert DayTable(spark, str(tmp_path / "none"), SCHEMA, "id").read().count() == 0


def test_a_stream_of_changes_is_committed_by_batch(spark, tmp_path):
    table = filled(spark, tmp_path)
    before = table.read()
    schema = "id long, kind string, at timestamp_ntz, attempts int, last_error string, result string, processing_time_ms int"
    log = [(i % 20, ["start", "fail", "finish"][i // 20], T0 + timedelta(days=9, minutes=i), 1 + i // 20, f"e{i}", f"r{i}", i) for i in range(60)]
    path = str(tmp_path / "log")
    for part in (log[:30], log[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    want = rows(J.changed(spark.createDataFrame(rows(before), SCHEMA), spark.createDataFrame(log, schema)))
    version = ST.commit_changes(stream, table, J.changed, "worker", str(tmp_path / "progress"))
    assert rows(table.read()) == want and version == 3
    table.update(spark.createDataFrame(log[:30], schema), J.changed, ("worker", 0))  # replayed
    assert rows(table.read()) == want
