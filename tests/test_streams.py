"""Streams over several batches give what their batch twins give; repeats change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codesift.operators import jobs as J, reuse as U
from codesift.sources import io
from codesift.streaming import streams as ST

T0 = datetime(2024, 1, 1)


def folder(spark, tmp_path, rows, schema, parts):
    """Rows in time order, written as several files, the oldest first."""
    path = str(tmp_path / "in")
    for i in range(parts):
        part = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def deliveries(n=300):
    rnd = random.Random(3)
    return [(i, f"m{rnd.randint(0, 60)}", rnd.random() < 0.7, T0 + timedelta(seconds=i)) for i in range(n)]


DELIVERY = "delivery_id long, message_id string, failed boolean, delivered_at timestamp_ntz"
COLUMNS = ["delivery_id", "message_id", "attempt", "status"]


def as_set(df, columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_routing(spark, tmp_path):
    path, stream = folder(spark, tmp_path, deliveries(), DELIVERY, 3)
    want = as_set(J.route_deliveries(spark.read.parquet(path)), COLUMNS)
    assert as_set(ST.to_table(ST.route(stream), "routed"), COLUMNS) == want
    assert as_set(ST.route_by_batch(stream), COLUMNS) == want


@pytest.mark.parametrize("groups", [1, 7])
def test_messages_share_a_state_and_python_is_called_for_groups(spark, tmp_path, groups):
    """As the batch operator says over several days; at most one state for each group."""
    rnd = random.Random(5)
    rows = [(i, f"m{rnd.randint(0, 40)}", rnd.random() < 0.7, T0 + timedelta(hours=i / 9)) for i in range(600)]
    path, stream = folder(spark, tmp_path, rows, DELIVERY, 4)
    want = as_set(J.route_deliveries(spark.read.parquet(path)), COLUMNS)
    where = str(tmp_path / "routed")
    assert as_set(ST.to_table(ST.route(stream, groups=groups), "routed", where), COLUMNS) == want
    assert 1 <= spark.read.format("statestore").load(f"{where}/progress").count() <= groups


def test_routers_agree_over_days_and_go_on_where_they_stopped(spark, tmp_path):
    """Three batches two days apart; the last comes after a stop."""
    rnd = random.Random(8)
    rows = [(100 * b + i, f"m{rnd.randint(0, 12)}", rnd.random() < 0.8, T0 + timedelta(days=2 * b, hours=rnd.randint(0, 30)))
            for b in range(3) for i in range(40)]
    rows.sort(key=lambda r: r[3])
    path, _ = folder(spark, tmp_path, rows[:80], DELIVERY, 2)

    def stream():
        return spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", 1).parquet(path)
    where = {n: str(tmp_path / n) for n in ("state", "batch", "jobs", "first")}

    def reports():
        return stream().select(F.col("delivery_id").alias("id"), "message_id", F.col("message_id").alias("job_id"), F.lit("e").alias("last_error"),
                               F.col("delivered_at").alias("moved_to_dlq_at"))

    def run():
        return (as_set(ST.to_table(ST.route(stream()), "routed", where["state"]), COLUMNS),
                as_set(ST.route_by_batch(stream(), path=where["batch"]), COLUMNS),
                as_set(ST.dead_jobs(reports(), where["jobs"]), ["job_id", "id"]), as_set(ST.first_report(reports(), where["first"]), ["message_id", "id"]))
    first = run()
    spark.createDataFrame(rows[80:], DELIVERY).coalesce(1).write.mode("append").parquet(path)
    second = run()
    batch = spark.read.parquet(path)
    want = as_set(J.route_deliveries(batch), COLUMNS)
    assert second[0] == second[1] == want and len(want) == 120 and first[0] < second[0]
    last, earliest = {}, {}
    for i, m, _, t in rows:
        last[m] = max(last.get(m, (t, i)), (t, i))
        earliest[m] = min(earliest.get(m, (t, i)), (t, i))
    assert second[2] == {(m, i) for m, (_, i) in last.items()}
    assert second[3] == {(m, i) for m, (_, i) in earliest.items()}
    states = spark.read.parquet(f"{where['batch']}/rows-state/batch=2")
    assert states.count() <= 13


def test_late_rows_are_set_apart_and_old_misses_forgotten(spark, tmp_path):
    rows = [(1, "a", T0), (2, "a", T0 + timedelta(minutes=5)), (3, "b", T0 + timedelta(hours=5)), (4, "a", T0 + timedelta(hours=1)), (5, "b", T0 + timedelta(hours=5, minutes=1))]
    path, stream = folder(spark, tmp_path, rows, "job_id long, code_hash string, created_at timestamp_ntz", 5)
    where = str(tmp_path / "reuse")
    got = as_set(ST.reuse_labels(stream, path=where), ["job_id", "hit"])
    assert got == {(1, False), (2, True), (3, False), (4, None), (5, True)}
    assert as_set(spark.read.parquet(f"{where}/rows-state/batch=4"), ["code_hash"]) == {("b",)}


def test_deadlines_and_retention(spark, tmp_path):
    rows = [(1, 1, "queued", T0), (1, 2, "processing", T0 + timedelta(seconds=40)), (1, 3, "complete", T0 + timedelta(seconds=50)),
            (2, 4, "queued", T0 + timedelta(seconds=55)), (3, 5, "queued", T0 + timedelta(hours=9)), (3, 6, "complete", T0 + timedelta(hours=9, seconds=1))]
    schema = "job_id long, event_id long, status string, ts timestamp_ntz"
    _, stream = folder(spark, tmp_path, rows, schema, 3)
    got = as_set(ST.to_table(ST.deadlines(stream, 30), "missed"), ["job_id", "event_id", "outcome"])
    assert got == {(1, 1, "late"), (2, 4, "open")}
    kept, counts = ST.retention(stream.withColumnRenamed("ts", "moved_to_dlq_at"), 0)
    assert kept.count() == 1 and counts.agg(F.sum("dropped")).first()[0] == 5


@pytest.mark.parametrize("hot_rows", [10_000, 40])
def test_reuse(spark, tmp_path, hot_rows):
    rnd = random.Random(5)
    times = sorted(rnd.randint(0, 30_000) for _ in range(400))
    rows = [(i, rnd.choice(["hot", "hot", f"h{rnd.randint(0, 9)}"]), T0 + timedelta(seconds=s)) for i, s in enumerate(times)]
    path, stream = folder(spark, tmp_path, rows, "job_id long, code_hash string, created_at timestamp_ntz", 3)
    want = as_set(U.label(spark.read.parquet(path)), ["job_id", "hit"])
    assert as_set(ST.reuse_labels(stream, hot_rows=hot_rows), ["job_id", "hit"]) == want


def test_dead_letters_with_repeats(spark, tmp_path):
    rows = [(i, f"m{i % 7}", T0 + timedelta(seconds=i)) for i in range(40)]
    schema = "id long, message_id string, moved_to_dlq_at timestamp_ntz"
    path, stream = folder(spark, tmp_path, rows, schema, 2)
    spark.createDataFrame(rows[:20], schema).coalesce(1).write.mode("append").parquet(path)  # the same rows again
    assert as_set(ST.first_report(stream), ["message_id", "id"]) == {(f"m{i}", i) for i in range(7)}


def test_latest_status_and_dashboard(spark, tmp_path):
    rows = [(i % 5, i, ["queued", "processing", "complete"][i % 3], T0 + timedelta(seconds=i), 10 * i) for i in range(30)]
    schema = "job_id long, event_id long, status string, ts timestamp_ntz, processing_time_ms int"
    path, stream = folder(spark, tmp_path, rows, schema, 3)
    batch = spark.read.parquet(path)
    assert as_set(ST.latest_status(stream), ["job_id", "status", "ts"]) == as_set(J.latest_state(batch), ["job_id", "status", "ts"])
    assert ST.dashboard(stream, J.rollup, "dash").collect() == J.rollup(batch).collect()


def test_possible_hits_bound_the_real_ones(spark, tmp_path):
    rows = [(i, f"h{i % 3}", T0 + timedelta(seconds=700 * i)) for i in range(60)]
    path, _ = folder(spark, tmp_path, rows, "job_id long, code_hash string, created_at timestamp", 1)
    read = spark.readStream.schema("job_id long, code_hash string, created_at timestamp").parquet
    done = read(path).filter("job_id % 4 = 0").select("code_hash", F.col("created_at").alias("completed_at"))
    got = {r.job_id for r in ST.to_table(ST.possible_hits(read(path), done), "possible").collect()}
    want = {i for i, h, t in rows if any(j % 4 == 0 and k == h and c <= t < c + timedelta(hours=1) for j, k, c in rows)}
    assert got == want


LOG = "job_id long, event_id long, status string, ts timestamp_ntz"


def log_rows(n=240):
    rnd = random.Random(12)
    times = sorted(rnd.randint(0, 4000) for _ in range(n))
    return [(rnd.randint(0, 30), i, rnd.choice(["queued", "processing", "retrying", "complete", "dlq"]), T0 + timedelta(seconds=t)) for i, t in enumerate(times)]


def missed_by_hand(rows, seconds=30):
    out, by = set(), {}
    for job, event, status, t in sorted(rows, key=lambda r: (r[3], r[1])):
        if job in by and by[job][1] not in J.TERMINAL and (t - by[job][2]).total_seconds() > seconds:
            out.add((job, by[job][0], "late"))
        by[job] = event, status, t
    now = max(r[3] for r in rows)
    return out | {(job, e, "open") for job, (e, s, t) in by.items() if s not in J.TERMINAL and (now - t).total_seconds() > seconds}


@pytest.mark.parametrize("parts", [1, 4])
def test_missed_deadlines_of_both_kinds(spark, tmp_path, parts):
    rows = log_rows()
    path, stream = folder(spark, tmp_path, rows, LOG, parts)
    missed, behind = ST.missed_deadlines(stream, 30)
    assert as_set(missed, ["job_id", "event_id", "outcome"]) == missed_by_hand(rows) and behind.count() == 0
    batch = J.stuck(spark.read.parquet(path), 30)
    assert as_set(missed.filter("outcome = 'open'"), ["job_id", "event_id"]) == as_set(batch, ["job_id", "event_id"])


def test_rows_behind_their_job_are_kept_apart_and_none_is_lost(spark, tmp_path):
    rows = log_rows()
    late = [r for r in rows[:80] if r[1] % 3 == 0]
    order = [r for r in rows if r not in late] + late
    _, stream = folder(spark, tmp_path, order, LOG, 3)
    missed, behind = ST.missed_deadlines(stream, 30)
    apart = as_set(behind, ["event_id"])
    # a late row that no later one of its job had come before is placed; all others are told
    placed = [r for r in rows if (r[1],) not in apart]
    assert apart and apart <= {(r[1],) for r in late}
    assert as_set(missed, ["job_id", "event_id", "outcome"]) == missed_by_hand(placed)


def test_a_batch_writes_what_it_holds_and_not_the_table(spark, tmp_path, monkeypatch):
    """Runs: many keys first, then small batches; what these write does not follow the table."""
    monkeypatch.setattr(ST.Runs, "ROWS_PER_FOLDER", 512)
    table = ST.Runs(spark, str(tmp_path / "t"), "k long, v long", "k", ST.newest_by("k", ["v"]))
    want = {}
    sizes = []
    for batch in range(10):
        rows = [(k, batch) for k in range(6000)] if batch == 0 else [(batch * 37 % 6000, batch), (7000 + batch, batch)]
        want |= dict(rows)
        table.add(batch, spark.createDataFrame(rows, "k long, v long"))
        if batch in (0, 3):
            table.add(batch, spark.createDataFrame(rows, "k long, v long"))  # replayed
        live = table.live(batch)
        sizes.append(sum(r[3] for r in live if r[0].startswith(f"{batch}-")))
        if batch not in (0, 3, 4, 9):
            continue
        assert {tuple(r) for r in table.all(batch).collect()} == set(want.items())
        keys = spark.createDataFrame([(37,), (7001,), (-1,)], "k long")
        assert {tuple(r) for r in table.known(batch, keys).collect()} == {(k, want[k]) for k in (37, 7001) if k in want}
    assert live[0][2] >= 8 and max(sizes[1:3]) <= 4  # the large run is cut; small batches write themselves
    assert sum(s > 100 for s in sizes[1:]) <= 2  # and merge with the large one only when there are four like it
    assert len(live) <= 6 and table.all().count() == len(want)


def test_letter_dashboard_has_all_statistics(spark, tmp_path):
    from codesift.operators import deadletters as DL
    rows = [(i, i % 7 if i % 5 else None, i % 3 == 0, i % 4, T0 + timedelta(minutes=i * 7 % 50)) for i in range(60)]
    path, stream = folder(spark, tmp_path, rows, "id long, job_id long, resolved boolean, retry_count int, moved_to_dlq_at timestamp_ntz", 4)
    got, want = ST.letter_dashboard(stream).first().asDict(), DL.statistics(spark.read.parquet(path)).first().asDict()
    assert got == want


def test_retention_drops_days_without_writing_what_is_kept(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=5 * i)) for i in range(100)] + [(1000, None)]
    path, stream = folder(spark, tmp_path, rows, "id long, moved_to_dlq_at timestamp_ntz", 5)
    where = tmp_path / "kept"
    kept, counts = ST.retention(stream, 3, str(where))
    newest = max(t for _, t in rows if t)
    assert as_set(kept, ["id"]) == {(i,) for i, t in rows if t is None or t >= newest - timedelta(days=3)}
    per = {r["batch"]: (r["kept"], r["dropped"]) for r in counts.collect()}
    seen = dropped = 0
    for b in range(5):
        part = rows[: (b + 1) * len(rows) // 5]
        now = max(t for _, t in part if t)
        alive = sum(t is None or t >= now - timedelta(days=3) for _, t in part)
        dropped += per[b][1]
        assert per[b][0] == alive and dropped == len(part) - alive
    versions = sorted(int(p.name[8:]) for p in (where / "rows").glob("version=*"))
    written = {v: sum(1 for _ in (where / "rows" / f"version={v}").glob("day=*")) for v in versions}
    assert written[0] == 0 and written[4] > 0  # folders of the first batch are gone


def test_routers_agree_on_a_backfilled_batch_and_no_row_is_lost(spark, tmp_path):
    rows = deliveries(120)
    rows = rows[:40] + [(i, m, f, t + timedelta(days=4)) for i, m, f, t in rows[40:80]] + [
        (i, m, f, t + timedelta(days=4) if i % 2 else t) for i, m, f, t in rows[80:]]  # the last batch brings old deliveries
    path, stream = folder(spark, tmp_path, rows, DELIVERY, 3)
    late = {r[0] for r in rows[80:] if not r[0] % 2}
    by_state, by_batch = (as_set(ST.route_in_time(stream, b, path=str(tmp_path / f"routed-{b}")), COLUMNS) for b in (False, True))
    want = as_set(J.route_deliveries(spark.read.parquet(path).filter(~F.col("delivery_id").isin(*late))), COLUMNS)
    assert by_state == by_batch == want | {(i, m, None, "late") for i, m, _, _ in rows if i in late}
    assert len(by_state) == 120 and len(late) == 20


def test_possible_hits_with_late_rows_on_both_sides(spark, tmp_path):
    def at(minutes):
        return T0 + timedelta(minutes=minutes)
    schema = "job_id long, code_hash string, created_at timestamp_ntz, kind string"
    # batch 0: up to minute 200; batch 1: a completion an hour old, a submission of the past; batch 2: rows too old on both sides
    batches = [[(1, "a", at(150), "sent"), (2, "b", at(10), "sent"), (3, "a", at(200), "sent"), (None, "b", at(0), "done")],
               [(None, "a", at(140), "done"), (4, "b", at(59), "sent"), (5, "b", at(130), "sent"), (6, "c", at(300), "sent")],
               [(None, "c", at(170), "done"), (7, "a", at(180), "sent"), (8, "a", at(199), "sent"), (None, "c", at(290), "done")]]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet
    hits, late = ST.possible_hits_by_batch(read(path).filter("kind = 'sent'"),
                                           read(path).filter("kind = 'done'").withColumnRenamed("created_at", "completed_at"))
    assert as_set(late, ["job_id", "code_hash"]) == {(4, "b"), (None, "c"), (7, "a")}
    # 1 and 6 get their completion with the next batch; 3 and 5 are an hour or more after theirs
    assert as_set(hits, ["job_id"]) == {(1,), (2,), (6,), (8,)} and hits.count() == 4


def test_sinks_of_whole_files_are_compressed_and_read_back(spark, tmp_path):
    rows = [(i, f"h{i % 5}", f"f{i}.js", f"let a{i % 5} = 1;\n\t\"ü\u2028\" " * 400) for i in range(100)]
    sent = spark.createDataFrame(rows, "job_id long, code_hash string, file_name string, content string").withColumn("user_id", F.lit(None).cast("int"))
    queue, box = str(tmp_path / "queue"), str(tmp_path / "box")
    io.publish(sent, queue)
    io.write_submissions(sent, box)
    got = as_set(ST.to_table(io.read_messages(spark, queue), "consumed"), ["jobId", "codeHash", "fileName", "fileContent"])
    assert got == {(str(a), b, c, d) for a, b, c, d in rows}
    assert as_set(io.read_submissions(spark, box), ["user_id", "file_name", "content"]) == {(io.DEFAULT_USER, c, d) for _, _, c, d in rows}
    whole = sum(len(r[3].encode()) for r in rows)
    for folder_ in (queue, box):
        assert sum(p.stat().st_size for p in (tmp_path / folder_).glob("part-*")) < whole / 3
