"""Reuse counted from completion against plain Python: several misses in flight, results that never come or come late."""

import random
from datetime import datetime, timedelta

import pytest

from codesift.operators import reuse as U
from codesift.streaming import streams as ST

START = datetime(2024, 1, 1)
SCHEMA = "job_id long, code_hash string, created_at timestamp_ntz, completed_at timestamp_ntz"
TTL = timedelta(seconds=3600)


def by_hand(rows):
    """One job after another; a miss answers later jobs from its completion on."""
    misses, hits = {}, {}
    for job, h, t, done in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = any(c <= t < c + TTL for c in misses.get(h, []))
        if not hit and done is not None:
            misses.setdefault(h, []).append(max(done, t))
        hits[job] = hit
    return hits


def labels(spark, rows, **kw):
    return {r.job_id: r.hit for r in U.label(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def at(s):
    return None if s is None else START + timedelta(seconds=s)


def some_rows(n, seed, durations, span=60_000, hot=0.5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randint(0, span)
        d = rnd.choice(durations)
        rows.append((i, "hot" if rnd.random() < hot else f"h{rnd.randint(0, 20)}", at(t), at(None if d is None else t + d)))
    return rows


def test_misses_in_flight(spark):
    rows = [(1, "a", at(0), at(100)), (2, "a", at(50), at(400)), (3, "a", at(100), at(101)), (4, "a", at(3999), at(4010)),
            (5, "a", at(4000), at(4001)), (6, "b", at(0), None), (7, "b", at(10), at(10)), (8, "b", at(10), at(20)), (9, "b", at(3610), at(3611)),
            (10, "c", at(0), at(10)), (11, "c", at(5), at(9000)), (12, "c", at(4000), at(4100)), (13, "c", at(9001), at(9002))]
    want = {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False, 8: True, 9: False, 10: False, 11: False, 12: False, 13: True}
    assert by_hand(rows) == want and labels(spark, rows) == want and labels(spark, rows, hot_rows=0) == want


@pytest.mark.parametrize("durations", [[0], [1, 30, 200, 900], [0, 5, None, 2500, 3600, 3601, 9000, 20_000]], ids=["at once", "short", "any"])
def test_both_ways_agree_with_plain_python(spark, durations):
    rows = some_rows(500, len(durations), durations)
    want = by_hand(rows)
    assert labels(spark, rows) == want
    assert labels(spark, rows, hot_rows=100) == want  # the hot hash is followed by joins
    assert 0 < sum(want.values()) < len(rows)


def test_completion_at_submission_is_the_plain_rule(spark):
    rows = some_rows(400, 9, [0])
    plain = spark.createDataFrame([r[:3] for r in rows], "job_id long, code_hash string, created_at timestamp_ntz")
    assert labels(spark, rows, hot_rows=50) == {r.job_id: r.hit for r in U.label(plain).collect()}


def test_nothing_and_nulls(spark):
    assert labels(spark, []) == {}
    rows = [(1, "a", at(0), at(-50)), (2, "a", at(0), None), (3, "a", at(1), None)]
    assert labels(spark, rows) == labels(spark, rows, hot_rows=0) == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("hot_rows", [1_000, 40])
def test_stream_agrees_with_plain_python_over_batches(spark, tmp_path, hot_rows):
    rows = sorted(some_rows(240, 11, [0, 20, 700, None, 5000]), key=lambda r: (r[2], r[0]))
    path = str(tmp_path / "in")
    for part in (rows[:90], rows[90:180], rows[180:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    where = str(tmp_path / "out")
    got = {r.job_id: r.hit for r in ST.reuse_from_completion(stream, hot_rows=hot_rows, path=where).collect()}
    assert got == by_hand(rows)
    kept = spark.read.parquet(f"{where}/rows-state/batch=2")
    now = (rows[-1][2] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert kept.filter(kept.effect + 7_200_000_000 <= 2 * now).count() == 0  # dead results are forgotten
    assert kept.filter(kept.effect <= 2 * now).groupBy("code_hash").count().filter("count > 1").count() == 0
