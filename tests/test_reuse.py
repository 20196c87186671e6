"""Reuse labels and look-ups against plain Python, hot keys included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codesift.operators import reuse as U
from codesift.operators.asof import nearest

START = datetime(2024, 1, 1)
SCHEMA = "job_id long, code_hash string, created_at timestamp_ntz"


def greedy(rows, ttl=3600):
    last, hits = {}, {}
    for job, h, t in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = h in last and t < last[h] + timedelta(seconds=ttl)
        if not hit:
            last[h] = t
        hits[job] = hit
    return hits


def some_rows(n, seed, hot=0.35):
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < hot else f"h{rnd.randint(0, 30)}",
             START + timedelta(seconds=rnd.randint(0, 40_000), microseconds=rnd.choice([0, 1, 999_999]))) for i in range(n)]


def labels(spark, rows, **kw):
    return {r.job_id: r.hit for r in U.label(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_known_example(spark):
    seconds = [0, 1000, 3599, 3600, 3700, 7300, 9000, 11000]
    rows = [(i, "a", START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    got = labels(spark, rows)
    assert [got[i] for i in range(8)] == [False, True, True, False, True, False, True, False]
    assert labels(spark, rows, hot_rows=2) == got


def test_cold_and_hot_path_agree_with_plain_python(spark):
    rows = some_rows(3000, 1)
    want = greedy(rows)
    assert labels(spark, rows) == want
    assert labels(spark, rows, hot_rows=300) == want  # the hot hash goes through doubling


def test_result_does_not_depend_on_partitions(spark):
    rows = some_rows(800, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    a = {tuple(r) for r in U.label(df.repartition(13)).select("job_id", "hit").collect()}
    b = {tuple(r) for r in U.label(df.coalesce(1)).select("job_id", "hit").collect()}
    assert a == b


def test_live_entry(spark):
    rows = some_rows(600, 3)
    rnd = random.Random(4)
    cache = [(rnd.choice(["hot", "h1", "h2", "h3"]), START + timedelta(seconds=rnd.randint(0, 40_000))) for _ in range(60)]
    got = {r.job_id: r.cached_at for r in U.live_entry(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(cache, "code_hash string, cached_at timestamp_ntz")).collect()}
    for job, h, t in rows:
        live = [c for k, c in cache if k == h and c <= t < c + timedelta(seconds=3600)]
        assert got[job] == (max(live) if live else None)


def test_nearest_both_ways(spark):
    rnd = random.Random(5)
    probes = [(i, rnd.choice("ab"), rnd.randint(0, 1000)) for i in range(300)]
    points = [(rnd.choice("ab"), rnd.randint(100, 900)) for _ in range(40)]
    p, q = spark.createDataFrame(probes, "i long, k string, t long"), spark.createDataFrame(points, "k string, y long")
    for forward in (True, False):
        got = {r.i: r.matched for r in nearest(p, q, ["k"], "t", "y", forward, cell_micros=37).collect()}
        for i, k, t in probes:
            fit = [y for kk, y in points if kk == k and (y >= t if forward else y <= t)]
            assert got[i] == (None if not fit else min(fit) if forward else max(fit))


def test_statistics_and_hit_document(spark):
    empty = spark.createDataFrame([], "hit boolean")
    assert tuple(U.statistics(empty).first()) == (0, 0, 0.0)
    three = spark.createDataFrame([(True,), (False,), (True,)], "hit boolean")
    assert tuple(U.statistics(three).first()) == (2, 1, 66.67)
    doc = spark.createDataFrame([(("a.js", ("1.5s", 1500)),), (("b.js", (None, None)),)],
                                "r struct<fileName:string,metrics:struct<reviewTime:string,processingTimeMs:int>>")
    got = [tuple(r) for r in doc.select(U.hit_result(F.col("r"))["metrics"].alias("m")).select("m.*").collect()]
    assert got == [("<0.1s", 0, "1.5s", 1500), ("<0.1s", 0, "N/A", 0)]


@pytest.mark.parametrize("forward", [True, False])
def test_nearest_with_one_key_in_most_rows(spark, forward):
    rnd = random.Random(4)
    point_rows = [("hot" if rnd.random() < 0.9 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 20_000_000_000)) for _ in range(700)]
    probe_rows = [(i, "hot" if rnd.random() < 0.9 else f"k{rnd.randint(0, 6)}", rnd.randint(0, 20_000_000_000)) for i in range(700)]
    probes = spark.createDataFrame(probe_rows, "i long, k string, p long")
    points = spark.createDataFrame(point_rows, "k string, c long")
    got = {r.i: r.matched for r in nearest(probes, points, ["k"], "p", "c", forward, 1_000_000, 60).collect()}
    for i, k, p in probe_rows:
        near = [c for h, c in point_rows if h == k and (c >= p if forward else c <= p)]
        assert got[i] == ((min(near) if forward else max(near)) if near else None)
